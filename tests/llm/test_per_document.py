"""Operators that judge each document by itself, against brute force."""

import base64
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skeinlake.llm import common, compression, crossparse, nbsvm, sp_backend, syncmers


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abAB é\n.9ÜñЖ", max_size=60), max_size=8))
def test_word_hashes_tell_words_apart(texts):
    data, offsets = common.utf8(pa.array(texts, pa.string()))
    h, begins = common.words(data, offsets)
    lower = lambda t: "".join(c.lower() if c.isascii() or "À" <= c <= "Þ" else c for c in t)
    want = [re.findall(r"[0-9a-z\u0080-\U0010ffff]+", lower(t)) for t in texts]
    assert [len(w) for w in want] == np.diff(begins).tolist()
    seen = {}
    for t, w in enumerate(want):
        for word, x in zip(w, h[begins[t] : begins[t + 1]]):
            assert seen.setdefault(word, x) == x
    assert len(set(seen.values())) == len(seen)


def test_long_text_is_hashed_in_pieces(monkeypatch):
    texts = ["aa bb " * 50, "", "cc", "dd ee " * 40]
    data, offsets = common.utf8(pa.array(texts))
    whole = common.words(data, offsets)
    monkeypatch.setattr(common, "CHUNK_BYTES", 17)
    pieces = common.words(data, offsets)
    assert all((a == b).all() for a, b in zip(whole, pieces))


def test_grams_of_short_texts():
    data, offsets = common.utf8(pa.array(["a b c d", "a b", "", "b"]))
    g, begins = common.grams(*common.words(data, offsets), 3)
    assert np.diff(begins).tolist() == [2, 1, 0, 1] and len(set(g.tolist())) == 4


# Compression bands


def test_compression_against_brute_force(documents):
    import zstandard

    press = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False).compress
    texts = {r["doc_id"]: r["text"].encode() for r in documents.collect()}
    for r in compression.compression_bands(documents).collect():
        b = texts[r["doc_id"]]
        assert r["n_bytes"] == len(b) and (not b or r["ratio"] == pytest.approx(len(b) / len(press(b))))
        if len(b) >= 4096:
            each = [4096 / len(press(b[k : k + 4096])) for k in range(0, len(b) - 4095, 4096)]
            assert (r["chunk_low"], r["chunk_high"]) == pytest.approx((min(each), max(each)))


def test_compression_catches_repetition_and_noise(spark):
    rng = np.random.default_rng(1)
    noise = base64.b64encode(rng.bytes(4000)).decode()
    prose = " ".join("".join(rng.choice(list("etaoinshr"), rng.integers(2, 9))) for _ in range(900))
    late = prose + " " + "spam and eggs " * 900
    df = spark.createDataFrame([(1, "again " * 400), (2, noise), (3, prose), (4, late), (5, "short")], "doc_id long, text string")
    got = {r["doc_id"]: r["reason"] for r in compression.compression_bands(df).collect()}
    assert got[1] == "repetitive" and got[2] == "incompressible" and got[3] is None and got[4] in ("repetitive", "repetitive chunk") and got[5] is None


def test_compression_judges_the_end_of_a_text(spark):
    import zstandard

    press = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False).compress
    rng = np.random.default_rng(1)
    prose = " ".join("".join(rng.choice(list("etaoinshr"), rng.integers(2, 9))) for _ in range(2000))
    spam, noise = (prose[:4200] + x for x in ("spam and eggs " * 300, base64.b64encode(rng.bytes(4000)).decode()))
    texts = [spam[:8191], noise[:8191], prose[:8191], prose[:8192], prose[:4096], prose[:4097], prose[:4095], None]
    rows = sorted(compression.compression_bands(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert [r["reason"] for r in rows] == ["repetitive chunk", "incompressible chunk", *[None] * 5, "empty"]
    assert [r["chunk_last"] for r in rows] == [pytest.approx(4096 / len(press(t[-4096:].encode()))) if t and len(t) > 4096 and len(t) % 4096 else None for t in texts]


def test_compression_edges(odd, none):
    rows = compression.compression_bands(odd).collect()
    assert len(rows) == odd.count() and compression.compression_bands(none).count() == 0
    by = {r["doc_id"]: r for r in rows if r["doc_id"]}
    assert by[3]["reason"] == by[4]["reason"] == "empty" and by[3]["n_bytes"] is None and by[6]["reason"] == "repetitive"


# Classifier


def test_features_once_each():
    data, offsets = common.utf8(pa.array(["abcabc", "", "ab", "abcd"]))
    values, begins = nbsvm.features(data, offsets, (3,), 16)
    assert np.diff(begins).tolist() == [3, 0, 0, 2]
    assert values[begins[0]] == values[begins[3]]


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 40, 12)).astype(np.int32) for _ in range(60)]
    labels = [int(5 in r or 7 in r) for r in rows]
    m = nbsvm.fit(rows, labels, bits=6, epochs=300)
    x = np.zeros((60, 64))
    for k, r in enumerate(rows):
        x[k, r] = m.ratios[r] / np.sqrt((m.ratios[r] ** 2).sum())
    y = np.where(np.array(labels) > 0, 1, -1)
    c = np.where(y > 0, 600 / (2 * (y > 0).sum()), 600 / (2 * (y < 0).sum()))
    loss = lambda w: 0.5 * w @ w + (c * np.maximum(0, 1 - y * (x @ w))).sum()
    assert all(loss(m.weights) <= 1.01 * loss(m.weights + rng.normal(0, s, 64)) for s in (0.001, 0.01, 0.1) for _ in range(50))


def test_classifier_holds_on_held_out_rows(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train, test = lab.where("doc_id % 3 <> 0"), lab.where("doc_id % 3 = 0")
    scored = nbsvm.quality_scores(d, train).join(test, "doc_id").toPandas()
    good, bad = scored[scored.quality == 1], scored[scored.quality == 0]
    assert good.keep.mean() > 0.97 and bad.keep.mean() < 0.2


def test_classifier_edges(odd, none, odd_labels, no_labels):
    rows = nbsvm.quality_scores(odd, odd_labels).collect()
    assert len(rows) == odd.count() and nbsvm.quality_scores(none, odd_labels).count() == 0
    assert {r["doc_id"]: r["keep"] for r in rows if r["doc_id"] in (3, 4)} == {3: False, 4: False}
    assert all(r["keep"] for r in nbsvm.quality_scores(odd, no_labels).collect() if r["doc_id"] not in (3, 4))
    bad = odd_labels.where("doc_id = 7")
    assert not any(r["keep"] for r in nbsvm.quality_scores(odd, bad).collect())
    kept = nbsvm.keep_quality(odd, odd_labels)
    assert kept.columns == odd.columns and kept.count() <= odd.count()


# Syncmers


def _brute_syncmers(text, k, s):
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    inner = syncmers._rolling(codes, s)
    out = []
    for i in range(len(codes) - k + 1):
        window = inner[i : i + k - s + 1]
        if min(window) in (window[0], window[-1]):
            out.append(i)
    return out


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcd é", max_size=120), st.integers(4, 12), st.integers(1, 3), st.integers(5, 40))
def test_syncmers_against_brute_force(text, k, s, block):
    at, _ = syncmers.syncmers(np.frombuffer(text.encode("utf-32-le"), np.uint32), k, s, block)
    assert at.tolist() == _brute_syncmers(text, k, s)


def test_rolling_hash_is_of_the_characters_alone():
    a, b = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in ("xxhello worldyy", "hello world"))
    for n in (1, 2, 3, 5, 7, 11):
        assert syncmers._rolling(a, n)[2] == syncmers._rolling(b, n)[0]


def test_shared_passage_gives_the_same_anchors(spark):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdefghij "), n))
    passage = word(600)
    df = spark.createDataFrame([(1, word(200) + passage + word(50)), (2, word(77) + passage), (3, word(400))], "doc_id long, text string")
    f = syncmers.closed_syncmers(df)
    got = {r["doc_id"]: dict(zip(r["hashes"], r["positions"])) for r in f.collect()}
    shared = set(got[1]) & set(got[2])
    assert len(shared) >= 30 and {got[1][h] - got[2][h] for h in shared} == {200 - 77} and not set(got[1]) & set(got[3])
    m = syncmers.matches(f.where("doc_id = 1"), f.where("doc_id = 2")).collect()
    assert [(r["left_id"], r["right_id"], r["shift"], r["anchors"]) for r in m] == [(1, 2, 123, len(shared))]


def test_syncmer_edges(odd, none, documents):
    rows = syncmers.closed_syncmers(odd).collect()
    assert len(rows) == odd.count() and syncmers.closed_syncmers(none).count() == 0
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["hashes"] is None and by[4]["hashes"] == [] and by[7]["positions"] == [] and len(by[6]["positions"]) > 0
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in syncmers.closed_syncmers(documents).limit(5).collect():
        assert r["positions"] == _brute_syncmers(texts[r["doc_id"]], syncmers.K, syncmers.S)
    with pytest.raises(ValueError):
        syncmers.closed_syncmers(odd, 5, 5)


# SentencePiece


@pytest.fixture(scope="module")
def original():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sp_backend.MODEL)


@pytest.fixture(scope="module")
def encoder():
    return sp_backend.Encoder(sp_backend.MODEL)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=("Cs",), exclude_characters="\x00"), max_size=50), max_size=4))
def test_encoder_has_the_ids_of_the_original(encoder, original, texts):
    ids, size, same = encoder(texts)
    want = original.encode(texts, num_threads=1) if texts else []
    assert size.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]
    assert all(ok or "▁" in t for ok, t in zip(same, texts))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \n▁é\t世", max_size=40))
def test_encoder_with_runs_of_spaces_and_lines(encoder, original, text):
    assert encoder([text])[0].tolist() == original.encode(text)


def test_encoder_forgets_and_stays_right(original):
    small = sp_backend.Encoder(sp_backend.MODEL, most=3)
    for text in ("one two three four five", "six seven eight", "one six"):
        assert small([text])[0].tolist() == original.encode(text)


def test_parity_on_whole_documents(documents, original):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    rows = sp_backend.sentencepiece_encode(documents).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["token_ids"] == original.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["token_ids"]) and r["round_trip"]


def test_decode_gives_texts_back(documents):
    back = sp_backend.sentencepiece_decode(sp_backend.sentencepiece_encode(documents))
    assert {tuple(r) for r in back.collect()} == {(r["doc_id"], r["text"]) for r in documents.collect()}


def test_unigram_model_is_rebuilt(tmp_path):
    """A unigram model built by hand, with byte fallback, against the original library."""
    import struct

    import sentencepiece

    varint = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)
    field = lambda k, b: varint(k << 3 | 2) + varint(len(b)) + b
    number = lambda k, n: varint(k << 3) + varint(n)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), *((f"<0x{k:02X}>", 0.0, 6) for k in range(256)), ("▁", -2.0, 1), ("▁the", -2.5, 1), ("t", -4.0, 1), ("h", -4.1, 1), ("e", -3.9, 1), ("he", -3.0, 1), ("re", -3.2, 1), ("r", -4.5, 1), ("▁there", -7.0, 1)]
    raw = b"".join(field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + number(3, kind)) for p, s, kind in pieces)
    raw += field(2, number(3, 1) + number(35, 1)) + field(3, field(1, b"identity") + number(3, 1) + number(4, 0) + number(5, 1))
    original = sentencepiece.SentencePieceProcessor(model_proto=raw)
    built = sp_backend.build(sp_backend.parse_model(raw))
    for text in ["the there", "there", "ther", "hehe reth", "x the", "é", "the  there", ""]:
        assert built.encode(text, add_special_tokens=False).ids == original.encode(text), text


def test_sentencepiece_edges(odd, none):
    rows = sp_backend.sentencepiece_encode(odd).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == odd.count() and sp_backend.sentencepiece_encode(none).count() == 0
    assert by[3]["token_ids"] is None and by[3]["n_tokens"] is None and by[3]["round_trip"] is None
    assert by[4]["token_ids"] == [] and by[4]["n_tokens"] == 0 and by[4]["round_trip"] and by[6]["round_trip"]


# Language ID


def _brute_phrases(text, sample):
    i = n = 0
    while i < len(text):
        size = 1
        while i + size <= len(text) and text[i : i + size] in sample:
            size += 1
        i += max(size - 1, 1)
        n += 1
    return n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc d", max_size=40), min_size=1, max_size=6), st.text(alphabet="abc ", min_size=1, max_size=40), st.text(alphabet="bcd ", min_size=1, max_size=40))
def test_phrases_against_brute_force(texts, one, two):
    plain = lambda t: re.sub(r"[\W\d_]+", " ", t)
    p = crossparse.Parser({"x": one, "y": two})
    data, off = common.utf8(pa.array(texts))
    got = p(*p.symbols(data[off[0] : off[-1]], np.concatenate([[0], np.cumsum([len(t) for t in texts])])))
    assert got.tolist() == [[_brute_phrases(plain(t), plain(s)) for s in (one, two)] for t in texts]


@pytest.mark.parametrize("flat", [127, 2])
def test_phrases_in_many_scripts_against_brute_force(monkeypatch, flat):
    monkeypatch.setattr(crossparse, "FLAT", flat)
    rng = np.random.default_rng(8)
    draw = lambda a, b, n: "".join(rng.choice([chr(c) for c in range(a, b) if chr(c).isalpha()] + [" "], n))
    scripts = {"cjk": (0x4E00, 0x4F40), "el": (0x3B1, 0x3CA), "la": (97, 123), "ru": (0x430, 0x450), "zz": (0x4EA0, 0x4FA0)}
    samples = {k: draw(*v, 1500) for k, v in scripts.items()}
    texts = [samples[k][300:340] + draw(*v, 60) for k, v in scripts.items()] + ["", "xñ"]
    plain = lambda t: re.sub(r"[\W\d_]+", " ", t)
    p = crossparse.Parser(samples)
    data, off = common.utf8(pa.array(texts))
    got = p(*p.symbols(data[off[0] : off[-1]], np.concatenate([[0], np.cumsum([len(t) for t in texts])])))
    assert got.tolist() == [[_brute_phrases(plain(t), plain(samples[k])) for k in sorted(samples)] for t in texts]


def test_rare_scripts_and_long_texts_are_answered(spark):
    """Languages whose letters are rare in all samples together, and one that has only texts beyond the bound."""
    rng = np.random.default_rng(9)
    draw = lambda a, b, n: "".join(rng.choice([chr(c) for c in range(a, b) if chr(c).isalpha()] + [" "] * 5, n))
    scripts = {"aa": (97, 123), "bb": (0x430, 0x450), "cc": (0x3B1, 0x3CA), "dd": (0x4E00, 0x4E80), "ee": (0x5D0, 0x5EB)}
    words = {k: [draw(*v, 6) for _ in range(60)] for k, v in scripts.items()}
    text = lambda k, n: " ".join(rng.choice(words[k], n))
    sizes = {"aa": 400, "bb": 60, "cc": 30, "dd": 30, "ee": 500}
    rows = [(10 * i + j, text(k, n + 10 * j), k) for i, (k, n) in enumerate(sizes.items()) for j in range(2)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(i, text(k, 20)) for i, k in enumerate(scripts)], "doc_id long, text string")
    got = crossparse.identify_languages(docs, labelled, chars=3000).collect()
    assert {r["doc_id"]: r["language"] for r in got} == dict(enumerate(scripts)) and all(r["margin"] > 0 for r in got)
    found = crossparse.samples(labelled, 3000)
    assert found["ee"] == min((t for _, t, k in rows if k == "ee"), key=len) and len(found["ee"]) > 3000


def test_languages_on_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = crossparse.identify_languages(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1")).join(d, "doc_id").toPandas()
    long = got[got.n_chars > 200]
    assert (long.language == long.lang).mean() > 0.97


def test_language_edges(odd, none, spark):
    rows = crossparse.identify_languages(odd).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == odd.count() and crossparse.identify_languages(none).count() == 0
    assert by[3]["language"] is None and by[4]["language"] is None and by[6]["language"] == "en"
    assert {r["language"] for r in crossparse.identify_languages(odd, none).collect()} == {None}
    one = spark.createDataFrame([(1, "some text", "en")], "doc_id long, text string, lang string")
    assert [(r["language"], r["phrases"], r["margin"]) for r in crossparse.identify_languages(one).collect()] == [("en", 1, None)]
    tie = spark.createDataFrame([(1, "same text", "b"), (2, "same text", "a")], "doc_id long, text string, lang string")
    assert {r["language"] for r in crossparse.identify_languages(tie).collect()} == {"a"}
