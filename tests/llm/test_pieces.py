import hashlib
import time

import messy
import numpy as np
import pytest
import sentencepiece

import corpus_pipeline
from quillrank.llm import pieces

ODD = [
    "",
    " ",
    "   ",
    "  two  spaces\n\tand ▁more  ",
    "日本語のテキスト 北京 ﬁ é 🙂🙂",
    "    return x;   }\n\n    def f(x):\n",
    "a" * 61 + " \x00c\xff",
    "internationalization " * 40,
    "x" * 3_000,
    "ПриветМир тест Ελληνικά עברית العربية हिन्दी",
]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_encoding_equals_the_library(spark, model):
    texts = ODD + [messy.prose(k, 200) for k in range(20)] + [messy.prose(k, 60, "que eau ß ment ñ ö") for k in range(10)]
    ids, counts = pieces.encode_texts(texts, pieces.vocabulary_of(pieces.MODEL))
    parts = [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])]
    assert parts == model.encode(texts)
    assert pieces.decode_ids(ids, counts, pieces.vocabulary_of(pieces.MODEL)) == [t.replace("▁", " ") for t in texts]


def test_long_runs_of_spaces_take_linear_time(model):
    vocabulary = pieces.vocabulary_of(pieces.MODEL)
    for text in (" " * 100_000, "a  " + "b" * 100_000, ("x" + " " * 7) * 12_000, "  " + "ab" * 30_000 + "   c"):
        start = time.perf_counter()
        ids, counts = pieces.encode_texts([text], vocabulary)
        assert time.perf_counter() - start < 10
        assert pieces.decode_ids(ids, counts, vocabulary) == [text]
        short = text[:3_000]
        assert pieces.encode_texts([short], vocabulary)[0].tolist() == model.encode(short)


def test_merges_of_the_border_are_decided_right():
    """For pairs of pieces: v may follow u if merging their text gives u and v."""
    vocabulary = pieces.vocabulary_of(pieces.MODEL)
    rng = np.random.default_rng(2)
    plain = np.array([i for i in vocabulary.usable if vocabulary.texts[i].isascii() and not vocabulary.texts[i].startswith(b" ")])
    u, v = rng.choice(plain, 4_000), rng.choice(plain, 4_000)
    told = vocabulary.decide(u.astype(np.int32), v.astype(np.int32))
    for a, b, fine in zip(u.tolist(), v.tolist(), told.tolist(), strict=True):
        texts = [vocabulary.texts[k].decode() for k in (a, b)]
        assert (vocabulary.merge("".join(texts)) == texts) == fine


def test_round_trip_of_messy_texts(spark, model):
    docs = messy.documents(spark)
    got = pieces.decode(pieces.encode(docs))
    rows = got.collect()
    assert messy.by_row(got, "doc_id", "ids_sha256", "decoded") == messy.by_row(pieces.encode(docs, decoded=True), "doc_id", "ids_sha256", "decoded")
    assert len(rows) == docs.count() and {"SCORE", "n_words", "source"} <= set(got.columns)
    for r in rows:
        assert r["ids"] == model.encode(r["text"] or "") and r["n_tokens"] == len(r["ids"])
        assert r["decoded"] == (r["text"] or "")
        assert r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<i4").tobytes()).hexdigest()
    assert pieces.encode(messy.empty(spark)).count() == 0


def test_query_round_trip(spark):
    assert all(r["round_trip"] for r in pieces.op9(spark, "/root/testdata/sf0.001").select("round_trip").collect())


def test_pipeline_stage_by_stage(spark, model):
    """Every stage against plain Python on what it got; its kept rows are those of its predecessor."""
    from test_decontamination import brute as hits
    from test_jaccard import brute as groups
    from test_substrings import brute as cuts

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    read = lambda frame: [(r["doc_id"], r["text"]) for r in frame.collect()]

    kept = stages["language_id"](spark, docs, sf)
    assert kept.columns == columns and kept.count() >= 0.99 * docs.count()

    before = read(kept)
    single = stages["jaccard_join"](spark, kept, sf)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(i for i, _, c in groups(before, 5, 80) if c == i)

    before = read(single)
    cut = stages["substring_dedup"](spark, single, sf)
    want = {i: digest for i, n, gone, digest in cuts(before, 50) if gone < n or n == 0}
    assert {i: hashlib.sha256(" ".join(messy.words(t)).encode()).hexdigest() for i, t in read(cut)} == want
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect()) and cut.columns == columns

    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    clean = stages["benchmark_decontamination"](spark, cut, sf)
    assert sorted(i for i, _ in read(clean)) == sorted(i for i, _, n, _ in hits(read(cut), items) if n == 0)

    texts = dict(read(clean))
    encoded = stages["piece_encoding"](spark, clean, sf).collect()
    assert {r["doc_id"]: r["ids"] for r in encoded} == {i: model.encode(t) for i, t in texts.items()}
    for r in encoded:
        text = texts[r["doc_id"]]
        assert r["round_trip"] and r["text_sha256"] == hashlib.sha256(text.replace("▁", " ").encode()).hexdigest()


def test_pipeline_bears_messy_rows(spark):
    docs = messy.documents(spark).select(*corpus_pipeline.COLUMNS, "SCORE")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, frame, "/root/testdata/sf0.001")
            assert name == "piece_encoding" or after.columns == corpus_pipeline.COLUMNS
            frame = after
        assert frame.count() <= docs.count()
