"""The pipeline: each stage on its own input, and all of them together."""

import sys

import corpus_pipeline
from skeinlake.llm import credentials, queries


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "secrets", "mixture", "encode"] and corpus_pipeline.ORACLE_SQL is None


def test_each_stage_on_all_that_was_kept(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        n = out.count()
        if name == "encode":
            assert n == kept and out.where("not round_trip").count() == 0
            break
        assert out.columns == columns and 0 < n <= kept
        if name == "quality":
            labels = spark.read.parquet(f"{sf}/labels.parquet")
            both = docs.join(labels, "doc_id").where("quality = 1")
            assert both.join(out.select("doc_id"), "doc_id", "left_semi").count() >= 0.95 * both.count()
        if name == "near_copies":
            from skeinlake.llm import jaccard_rtree

            assert jaccard_rtree.jaccard_pairs(out).count() == 0
        if name == "secrets":
            assert n == kept and credentials.secret_ownership(out).where("verdict = 'live'").count() == 0
        docs, kept = out, n


def test_run_gives_the_last_stage(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "token_ids", "n_tokens", "round_trip"] and out.count() > 0


def test_odd_rows_pass_every_stage(odd, none, spark, sf, odd_labels, tmp_path):
    odd_labels.write.parquet(str(tmp_path / "labels.parquet"))
    for k, frame in enumerate((odd, none)):
        docs = frame
        for name, stage in corpus_pipeline.STAGES:
            at = str(tmp_path / f"{k}-{name}")
            stage(spark, docs, str(tmp_path)).write.parquet(at)
            out = spark.read.parquet(at)
            assert name == "encode" or out.columns == frame.columns
            docs = out if name != "quality" else frame


def test_entry_has_every_operator():
    sys.path.insert(0, ".")
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(queries.ORACLES) <= set(entry.oracle_sql())


def test_near_copies_lists_no_grams_of_passages(spark, monkeypatch):
    """Passages of a far longer text can't be its near copies: only a copy of one goes, and at most that text, as its copy shares its grams, is listed."""
    from skeinlake.llm import jaccard_rtree

    rows, stored = {}, jaccard_rtree._stored

    def counted(df, name):
        out = stored(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(jaccard_rtree, "_stored", counted)
    passages = [" ".join(f"w{k}x{i}" for i in range(12)) for k in range(20)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([" ".join(passages), *passages, passages[0]])], "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == set(range(21))
    assert rows["jaccard-prefixes"] <= 1
