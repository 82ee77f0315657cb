"""Brute-force versions of what tables of results say, texts beyond a pass, and edges of the smaller functions."""

import re
import string
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
import zstandard

import corpus_pipeline
from skeinlake.llm import common, compression, credentials, crossparse, cube, hilbert, jaccard_rtree, nbsvm, sp_backend, syncmers, url_templates

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def huge(spark):
    """Texts of three million bytes, far beyond a pass: prose, one word without an end, other scripts, and a short one."""
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list(string.ascii_lowercase), rng.integers(2, 10))) for _ in range(3000)]
    prose = " ".join(rng.choice(vocabulary, 420_000))
    texts = [prose, prose[:2_900_000] + " and an end of its own", "a1" * 1_500_000, "漢字かな" * 250_000, "Привет мир, " * 150_000, "token = 'abc123def456ghi7' " + prose[:2_000_000], "short text", None]
    return spark.createDataFrame([(k, t, "en", "s", len(t) if t else None) for k, t in enumerate(texts)], DOC)


def test_texts_beyond_a_pass(spark, huge, no_labels):
    texts = {r["doc_id"]: r["text"] for r in huge.collect()}
    bands = {r["doc_id"]: r for r in compression.compression_bands(huge).collect()}
    assert bands[0]["n_bytes"] == len(texts[0]) and bands[2]["reason"] == "repetitive" and len(bands) == 8
    units = {r["doc_id"]: r["tokens"] for r in cube.balanced_sample(huge).collect()}
    assert units == {0: 420_000, 1: len(texts[1].split()), 2: 1, 3: 1_000_000, 4: 300_000, 5: len(texts[5].split()), 6: 2, 7: 0}
    scores = nbsvm.quality_scores(huge, spark.createDataFrame([(0, 1), (2, 0)], "doc_id long, quality int")).collect()
    assert {r["doc_id"]: r["keep"] for r in scores if r["doc_id"] in (0, 2, 7)} == {0: True, 2: False, 7: False}
    anchors = {r["doc_id"]: r for r in syncmers.closed_syncmers(huge).select("doc_id", "positions").collect()}
    assert len(anchors[0]["positions"]) > 2 * len(texts[0]) / 40 and anchors[7]["positions"] is None
    assert {(r["doc_id_a"], r["doc_id_b"]) for r in jaccard_rtree.jaccard_pairs(huge).collect()} >= {(0, 1), (0, 5)}
    encoded = {r["doc_id"]: r for r in sp_backend.sentencepiece_encode(huge).select("doc_id", "n_tokens", "round_trip").collect()}
    assert all(encoded[k]["round_trip"] for k in range(7)) and encoded[7]["n_tokens"] is None
    named = {r["doc_id"]: r["language"] for r in crossparse.identify_languages(huge, spark.createDataFrame([(1, texts[0][:5000], "en"), (2, texts[4][:5000], "ru")], "doc_id long, text string, lang string")).collect()}
    assert named[0] == named[1] == named[5] == "en" and named[4] == "ru" and named[7] is None
    found = credentials.secret_ownership(huge).collect()
    assert [(r["doc_id"], r["verdict"]) for r in found] == [(5, "live")]
    assert hilbert.hilbert_shards(huge).count() == 8


def test_long_urls(spark, no_labels):
    deep = "http://a.b/" + "/".join(f"p{k}" for k in range(3000))
    pages = spark.createDataFrame([(1, deep, "x"), (2, "http://a.b/" + "q" * 1_000_000, "x"), (3, None, None)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_templates.url_templates(pages, no_labels).collect()}
    assert len(got) == 3 and got[1]["template"].count("/") == url_templates.DEPTH and got[3]["template"] is None and all(r["keep"] for r in got.values())


def test_compression_verdicts_by_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    press = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False).compress
    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in d.select("doc_id", "text").collect()]
    want = {}
    for k, b in texts:
        reason = "empty" if not b else None
        if b:
            low, high, chunk_low, chunk_high = next(x[1:] for x in compression.BANDS if len(b) < x[0])
            whole = len(b) / len(press(b))
            cuts = [b[a : a + 4096] for a in range(0, len(b) - 4095, 4096)] + ([b[-4096:]] if len(b) > 4096 and len(b) % 4096 else [])
            each = [4096 / len(press(c)) for c in cuts]
            reason = "repetitive" if whole > high else "incompressible" if whole < low else "repetitive chunk" if any(x > chunk_high for x in each) else "incompressible chunk" if any(x < chunk_low for x in each) else None
        want[k] = (reason, reason is None)
    assert {r["doc_id"]: (r["reason"], r["keep"]) for r in compression.compression_bands(d).collect()} == want


def _ngrams(text, orders, bits):
    """Hashed byte n-grams, by plain integers."""
    out, mask = set(), (1 << 32) - 1
    for n in orders:
        for k in range(len(text) - n + 1):
            h = 0
            for c in text[k : k + n]:
                h = (h * 0x01000193 + c) & mask
            h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & mask
            h = (((h ^ (h >> 13)) * 0x297A2D39) + n & mask) >> (32 - bits)
            out.add(h)
    return out


def test_scores_by_brute_force(documents, labels):
    model = nbsvm.train(documents, labels)
    scores = {r["doc_id"]: r for r in nbsvm.quality_scores(documents, labels).collect()}
    for r in documents.where("length(text) < 1500").orderBy("doc_id").limit(25).collect():
        f = sorted(_ngrams((r["text"] or "").encode(), nbsvm.ORDERS, nbsvm.BITS))
        norm = max(sum(model.ratios[x] ** 2 for x in f), 1e-12) ** 0.5
        want = sum(model.weights[x] * model.ratios[x] for x in f) / norm + model.empty
        assert scores[r["doc_id"]]["score"] == pytest.approx(want, abs=1e-6) and scores[r["doc_id"]]["keep"] == (bool(r["text"]) and want >= model.threshold - 1e-9)


def test_long_text_has_the_features_of_its_pieces(monkeypatch):
    data, offsets = common.utf8(pa.array(["abcde fghij é " * 40]))
    whole = nbsvm.features(data, offsets)
    monkeypatch.setattr(nbsvm, "CHUNK_BYTES", 13)
    pieces = nbsvm.features(data, offsets)
    assert set(whole[0]) == set(pieces[0]) and pieces[1].tolist() == [0, len(whole[0])]


def test_probabilities_by_bisection(spark):
    rng = np.random.default_rng(4)
    tokens = {f"s{k}": int(rng.integers(1, 10 ** rng.integers(1, 6))) for k in range(40)} | {"none": 0}
    units = spark.createDataFrame([(s, t) for s, t in tokens.items()], "source string, tokens long")
    for share in (0.05, 0.5, 0.9, 1.0):
        low, high = 0.0, 1e9
        for _ in range(200):
            level = (low + high) / 2
            given = sum(min(t, level * t**0.5) for t in tokens.values())
            low, high = (level, high) if given < share * sum(tokens.values()) else (low, level)
        got = {r["source"]: r["p"] for r in cube.probabilities(units, None, share, 0.5).collect()}
        assert got["none"] == 1.0 and all(got[s] == pytest.approx(min(1.0, high * t**0.5 / t), abs=1e-6) for s, t in tokens.items() if t)


def test_joined_flights_keep_totals(spark, monkeypatch):
    monkeypatch.setattr(cube, "JOINED", 3)
    d = spark.createDataFrame([(k, "w " * (k % 17 + 1), "en", f"s{k % 2}", 1) for k in range(400)], DOC)
    got = cube.balanced_sample(d, block=10).toPandas()
    for _, part in got.groupby("source"):
        assert abs(part.selected.sum() - part.p.sum()) <= 2 and abs((part.selected * part.tokens).sum() - (part.p * part.tokens).sum()) <= 34


def test_tokens_of_scripts_without_spaces(spark):
    texts = ["日本語 のテスト abc", "ภาษาไทย ok", "한국어 말", "a漢b", None, ""]
    kind = lambda c: 0 if c.isspace() else 2 if any(a <= ord(c) <= b for a, b in common.UNSPACED) and unicodedata.category(c)[0] in "LMN" else 1
    want = [len(re.findall("2|1+", "".join(str(kind(c)) for c in t))) if t else 0 for t in texts]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(cube.words(cube.F.col("t"))).collect()] == want == [8, 8, 2, 3, 0, 0]


def test_segments_are_walked_as_whole_texts(monkeypatch):
    p = crossparse.Parser({"a": "the cat sat on the mat and ran", "b": "le chat est sur la table et dort"})
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("the catsonrlu "), n)) for n in (0, 1, 7, 50, 333)]
    data, off = common.utf8(pa.array(texts))
    codes, begins = p.symbols(data[off[0] : off[-1]], np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    want = p(codes, begins)
    for n in (1, 2, 5, 64):
        monkeypatch.setattr(crossparse, "SEGMENT", n)
        assert (p(codes, begins) == want).all()


def test_forest_connects_the_same_documents(spark, documents):
    copies = spark.createDataFrame([(10**6 + k, " ".join(f"w{j}" if (j * 7 + k) % 60 else f"x{k}" for j in range(300)), "en", "s", 1) for k in range(120)], DOC)
    d = documents.select(*copies.columns).unionByName(copies)
    both = [{tuple(r) for r in jaccard_rtree.groups(jaccard_rtree.jaccard_pairs(d, forest=f, tile=50)).collect()} for f in (False, True)]
    pairs, forest = jaccard_rtree.jaccard_pairs(d), jaccard_rtree.jaccard_pairs(d, forest=True)
    assert both[0] == both[1] and forest.count() < pairs.count() and forest.select("doc_id_a", "doc_id_b").exceptAll(pairs.select("doc_id_a", "doc_id_b")).count() == 0


def test_smaller_functions_on_empty_tables_and_nulls(spark, odd, none):
    pairs = spark.createDataFrame([], "doc_id_a long, doc_id_b long, jaccard double")
    assert jaccard_rtree.expand(pairs).count() == jaccard_rtree.groups(pairs).count() == 0
    empty, some = syncmers.closed_syncmers(none), syncmers.closed_syncmers(odd)
    assert syncmers.matches(empty, some).count() == syncmers.matches(some, empty).count() == 0
    assert {(r["left_id"], r["right_id"]) for r in syncmers.matches(some, some).where("left_id < right_id and shift = 0").collect()} == {(1, 2)}
    ids = spark.createDataFrame([(1, None), (2, []), (None, [1, 2])], "doc_id long, token_ids array<int>")
    assert {r["doc_id"]: r["text"] for r in sp_backend.sentencepiece_decode(ids).collect() if r["doc_id"]} == {1: None, 2: ""} and sp_backend.sentencepiece_decode(ids.where("false")).count() == 0
    assert hilbert.shard_boxes(none, hilbert.hilbert_shards(none)).count() == 0


def test_written_shards_are_pruned_by_every_dimension(spark, tmp_path):
    """With several shards a cell, as a corpus of many files has, a filter on any dimension leaves most files out."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    boxes = hilbert.write_shards(d, str(tmp_path / "out"), shard_chars=20_000).collect()
    assert sum(r["rows"] for r in boxes) == d.count() and spark.read.parquet(str(tmp_path / "out")).select(*d.columns).exceptAll(d).count() == 0
    overlapping = lambda name, low, high: sum(r[f"{name}_min"] <= high and r[f"{name}_max"] >= low for r in boxes) / len(boxes)
    share = d.groupBy("lang").count().collect()
    for r in share:
        assert overlapping("lang", r["lang"], r["lang"]) <= r["count"] / d.count() + 0.5
    assert overlapping("lang", "de", "de") < 0.6 and overlapping("source", "src3", "src3") < 0.35 and overlapping("n_chars", 0, 200) < 0.35


def test_written_shards_of_odd_rows(odd, none, tmp_path):
    hilbert.write_shards(odd, str(tmp_path / "odd"))
    back = odd.sparkSession.read.parquet(str(tmp_path / "odd"))
    assert back.count() == odd.count() and set(odd.columns) <= set(back.columns)


def test_more_forms_of_credentials(spark):
    good = ["AWS_SECRET_ACCESS_KEY=c7db7aa4a5fcc78305+/a", 'PASSWORD = "d7db7aa4a5fcc78305"', "API_KEY=e7db7aa4a5fcc78305", "key sk-proj-" + "aB3_" * 9, '{"password": "f7db7aa4a5fcc78305"}', "secret: wJalrXUtnFEMIKMDENGbPxRfiCYEXAMPLEKEYab"]
    bad = ['password = "changeme-please"', "token = request.headers.authorization", "token_count = 123456789012", "secret = aaaaaaaaaaaa1111", "password: correct-horse-battery", None, ""]
    d = spark.createDataFrame([(k, t, "en", f"s{k}", 1) for k, t in enumerate(good + bad)], DOC)
    assert sorted({r["doc_id"] for r in credentials.secret_ownership(d).collect()}) == list(range(len(good)))
    for most in (0, 1000):
        masked = {r["doc_id"]: r["text"] for r in credentials.mask_secrets(d, most=most).collect()}
        assert all("[secret]" in masked[k] for k in range(len(good))) and all(masked[len(good) + k] == t for k, t in enumerate(bad))


def test_both_ways_of_masking_agree(odd, spark):
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(credentials.mask_secrets(odd, most=0)) == rows(credentials.mask_secrets(odd, most=10**6))


def test_copies_that_went_still_tell_an_example(spark, tmp_path):
    key = "password=b7db7aa4a5fcc78305"
    raw = spark.createDataFrame([(k, f"one text with {key} number", "en", f"s{k}", 1) for k in range(6)], DOC)
    raw.write.parquet(str(tmp_path / "documents.parquet"))
    left = raw.where("doc_id = 0")
    assert corpus_pipeline.secrets(spark, left, str(tmp_path)).first()["text"] == left.first()["text"]
    assert "[secret]" in corpus_pipeline.secrets(spark, left, str(tmp_path / "nowhere")).first()["text"]
