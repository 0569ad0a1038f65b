import math
import re
import zlib
from collections import Counter

import messy
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillrank.llm import compression_quality, context_mixing, language
from quillrank.llm.host_rules import judge_hosts

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_texts(spark):
    got = language.op10(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_messy_texts(spark):
    docs = messy.documents(spark)
    got = language.identify(docs, docs)
    found = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == docs.count() and {"n_words", "SCORE"} & set(got.columns) == {"n_words"}
    assert found[3]["lang_pred"] == found[4]["lang_pred"] == found[5]["lang_pred"] == "und" and found[3]["score"] == 0
    assert found[20]["lang_pred"] == "fr" and found[8]["lang_pred"] == "en" and found[8]["readable"]
    assert not found[3]["readable"]
    assert language.identify(messy.empty(spark), docs).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, messy.empty(spark)).collect()} == {"und"}


def greedy_phrases(text: str, sample: str, block: int) -> int:
    """Cross-parsing by plain search."""
    n = 0
    for start in range(0, len(text), block):
        part, at = text[start : start + block], 0
        while at < len(part):
            size = 1
            while at + size < len(part) and part[at : at + size + 1] in sample and part[at] in sample:
                size += 1
            n, at = n + 1, at + size
    return n


def test_phrases_are_longest_matches():
    samples = {"a": messy.prose(1, 60), "b": messy.prose(2, 60, "que eau ment le ou ai")}
    parsed = language.Languages(samples)
    texts = [messy.prose(5, 200), "que eau xyz", "ß" * 7, "", "12 34", messy.prose(6, 90, "que eau the")]
    phrases, counts, lettered = parsed.phrases(texts)
    for k, text in enumerate(texts):
        symbols = " " + language.letters(text) if text.strip() and any(c.isalpha() for c in text) else " "
        assert counts[k] == len(symbols)
        letters = {c for s in samples.values() for c in s}
        symbols = "".join(c if c in letters else "\0" for c in symbols)
        for j, name in enumerate(parsed.names):
            assert phrases[k, j] == greedy_phrases(symbols, f" {samples[name]} ", language.BLOCK)
    assert lettered.tolist() == [True, True, True, False, False, True]


@pytest.mark.parametrize("dense", [0, 4_000_000])
def test_all_letters_of_the_samples_count(monkeypatch, dense):
    """Scripts with more letters than a byte holds, beside a language of small code points."""
    monkeypatch.setattr(language, "DENSE", dense)
    rng = np.random.default_rng(3)

    def text(first, size, n):
        return " ".join("".join(chr(first + c) for c in rng.integers(0, size, 4)) for _ in range(n))

    samples = {"en": messy.prose(1, 60), "ko": text(0xAC00, 900, 400), "zh": text(0x4E00, 900, 400)}
    parsed = language.Languages(samples)
    texts = [samples["ko"][100:160], samples["zh"][300:420], text(0x10A0 + 0x20000, 400, 30), messy.prose(5, 40), text(0xAC00, 900, 100)]
    phrases = parsed.phrases(texts)[0]
    known = {c for s in samples.values() for c in s}
    for k, t in enumerate(texts):
        symbols = "".join(c if c in known else "\0" for c in f" {t}")
        for j, name in enumerate(parsed.names):
            assert phrases[k, j] == greedy_phrases(symbols, f" {samples[name]} ", language.BLOCK)
    names, _, readable = parsed.predict(texts)
    assert names[:2] == ["ko", "zh"] and names[3:] == ["en", "ko"] and readable[:2].all() and not readable[2]


def test_few_rows_fill_a_languages_sample(spark):
    rows = [(k, messy.prose(k, 1_000), "few") for k in range(3)] + [(100 + k, f"{k} wort", "short") for k in range(500)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    parsed = language.learn(labelled, "text", "lang", "doc_id", 40, 2_000)
    sizes = {name: len(parser.keys if not parser.dense else parser.moves) // parser.size for name, (_, parser) in zip(parsed.names, parsed.tables, strict=True)}
    assert sizes["few"] > 2_000 and sizes["short"] >= 1_900
    assert language.filled(["a" * 9, "b" * 2, "c" * 9], 10, 3) == "aaaa bb cccc" and language.filled(["a", "b"], 9, 1) == "a b"


def test_quality_of_held_out_texts(spark):
    sf = "/root/testdata/sf0.1"
    got = compression_quality.op6(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    for label in (0, 1):
        own = [r["predicted"] == label for r in got if r["quality"] == label]
        assert sum(own) >= 0.85 * len(own)


def test_quality_of_messy_texts(spark):
    docs = messy.documents(spark)
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate([0, 1, 2, 6, 7, 8, 9, 12, 13, 14, 15, 16, 20])] + [(None, 1), (99, None)], "doc_id long, quality int")
    got = compression_quality.score_quality(docs, labels)
    assert got.count() == docs.count() and all(0 <= r["score"] <= 1 for r in got.collect())
    assert {r["score"] for r in compression_quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert compression_quality.score_quality(messy.empty(spark), labels).count() == 0


def model_rows(got):
    return {r["doc_id"]: r for r in got.collect()}


def test_language_model(spark):
    got = model_rows(context_mixing.op8(spark, SF))
    docs = {r["doc_id"]: messy.words(messy.lower(r["text"])) + [None] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    counts = Counter(w for i, ws in docs.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert set(got) == set(docs)
    for i, ws in docs.items():
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
    assert sum(r["score"] for r in got.values() if r["held_out"]) > sum(r["base_score"] for r in got.values() if r["held_out"])


def test_language_model_of_messy_texts(spark):
    docs = messy.documents(spark).withColumn("held_out", F.col("doc_id") == 2)
    got = context_mixing.mixing_scores(docs, chunk_rows=4)
    rows = got.collect()
    assert len(rows) == docs.count() and {"source", "_id"} <= set(got.columns)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert {r["n_tokens"] for r in rows if not messy.words(r["text"])} == {1}
    assert context_mixing.mixing_scores(docs.limit(0)).count() == 0
    untrained = context_mixing.mixing_scores(docs.withColumn("held_out", F.lit(True))).collect()
    assert {(r["train_tokens"], r["n_known"], r["base_score"]) for r in untrained} == {(0, 0, 0.0)}


def test_spelling_is_a_distribution():
    """Over all bytes at one place, under any context, the probabilities add up to one."""
    rng = np.random.default_rng(1)
    slots = np.arange(context_mixing.OFFSETS[-1])
    mixer = context_mixing.Mixer(slots, rng.integers(0, 5, len(slots)), rng.integers(0, 5, len(slots)))
    mixer.learn([messy.prose(k, 1).encode() for k in range(300)])
    ends = mixer.log10([b"tha" + bytes([c]) for c in range(256) if c != 32])
    stop = context_mixing.Mixer.log10(mixer, [b"tha"])
    spaces = {c: mixer.log10([b"tha" + bytes([c]), b"tha" + bytes([c, 101])]) for c in (97,)}
    assert np.isfinite(ends).all() and np.isfinite(stop).all() and spaces[97][0] > -300
    total = 0.0
    for bits in range(256):  # the tree of one byte's bits, at the start of a word
        spelled = context_mixing.Spellings([bytes([bits])] if bits != 32 else [b""])
        p = 0.0
        for k in range(8):
            bit, at = spelled.bit(k)
            x, gate = mixer.inputs([s[:1] for s in at])
            z = (x * mixer.weights[gate]).sum(axis=1)
            q = 0.5 * context_mixing.squash(z) + 0.5 * mixer.refined[gate, mixer.steps(z)]
            p += float(np.log(q[0] if bit[0] else 1 - q[0]))
        total += math.exp(p)
    assert math.isclose(total, 1.0, rel_tol=1e-5)


def test_spelling_sees_across_words_and_learns_in_the_text(spark):
    words = messy.prose(1, 200).split()
    shuffled = [words[k] for k in np.random.default_rng(1).permutation(len(words))]
    rows = [(k, " ".join(words), False) for k in range(20)] + [(100, " ".join(words), True), (101, " ".join(shuffled), True)]
    rows += [(102, "zqx vkj " * 100, True), (103, "zqx vkj", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    got = model_rows(context_mixing.mixing_scores(docs))
    assert got[100]["base_score"] == pytest.approx(got[101]["base_score"]) and got[100]["score"] > 0.7 * got[101]["score"]
    assert got[102]["score"] > 90 * got[103]["score"]
    alone = model_rows(context_mixing.mixing_scores(docs.where("doc_id != 102")))
    assert alone[101]["score"] == pytest.approx(got[101]["score"], rel=1e-6)


def test_models_are_fitted_on_all_training_text(spark):
    """Kinds and weights follow what lies beyond the first 2,000 characters, as one process finds them on the whole texts."""
    tails = ["ende und der das nicht", "fin mais le la pas"]
    texts = [("start " * 400 + (tails[k % 2] + " ") * 300).strip() for k in range(20)]
    rows = [(k, text, False) for k, text in enumerate(texts)] + [(98, None, True), (99, "held out words " * 2_000, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    seen = context_mixing.chunked(docs, 4).select("_chunk", F.col("held_out").alias("held"), "text")
    kinds = context_mixing.find_kinds(seen)
    assert len(kinds.words) == len(set(" ".join(texts).split()))
    found = [context_mixing.Words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])) for t in texts]
    kind = [int(kinds.of(f, f.hashes())[0]) for f in found]
    assert kind == kind[:2] * 10 and kind[0] != kind[1]
    assert math.isclose(np.exp(kinds.prior).sum(), 1, rel_tol=1e-4)

    counts = [b for b in context_mixing.count_bits([pa.record_batch([pa.array(texts)], names=["text"])])]
    alone = context_mixing.Mixer(*(np.concatenate([b.column(k).to_numpy() for b in counts]) for k in range(3)))
    start = alone.weights.copy()
    total = context_mixing.BitSums(alone.left_out(), alone.weights)
    for text in texts:
        total.add(context_mixing.Spellings.of(context_mixing.Words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])))[0])
    alone.fit(total.sums)
    assert not np.array_equal(alone.weights, start)
    assert np.allclose(context_mixing.spelling_model(seen.where("not held"), "text").weights, alone.weights, atol=2e-4)


def test_counts_of_bits_are_added_in_blocks_of_slots(spark):
    texts = [messy.prose(k, 40).lower() for k in range(12)] + [None, ""]
    counts = sum(context_mixing.bit_counts([pa.record_batch([pa.array([text], pa.string())], names=["text"])]) for text in texts)
    seen = []

    class Noted(context_mixing.Mixer):
        def __init__(self, slots, zeros, ones):
            seen.append((np.array(zeros), np.array(ones)))
            super().__init__(slots, zeros, ones)

    frame = spark.createDataFrame([(text,) for text in texts], "text string").repartition(4)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(context_mixing, "Mixer", Noted)
        context_mixing.spelling_model(frame, "text")
    assert (seen[0][0] == counts[:, 0]).all() and (seen[0][1] == counts[:, 1]).all()
    rows = list(context_mixing.count_blocks([pa.record_batch([pa.array(texts)], names=["text"])]))
    assert sum(batch.num_rows for batch in rows) <= context_mixing.OFFSETS[-1] // context_mixing.SLOT_BLOCK
    for value in ([0, 1, 255, 256, 2**31, 2**40 + 7], [0] * 6):
        assert context_mixing.of_planes(context_mixing.in_planes(np.array(value))).tolist() == value


def test_counts_of_millions_stay_finite():
    slots = np.arange(context_mixing.OFFSETS[-1])
    mixer = context_mixing.Mixer(slots, np.zeros(len(slots)), np.full(len(slots), 50_000_000))
    mixer.learn([b"some text"] * 9)
    assert np.isfinite(mixer.log10([b"some text", b""])).all()


def brute_measures(text):
    w = messy.words(text)
    windows: dict = {}
    for k in range(len(w) - 7):
        windows.setdefault(tuple(w[k : k + 8]), []).append(k)
    covered = {j for at in windows.values() if len(at) > 1 for k in at for j in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if messy.words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def brute_any(text, w):
    n, chars, symbols, dups, repeated = w
    lines = sum(bool(messy.words(x)) for x in (text or "").split("\n"))
    base = n < 20 or 100 * repeated > 30 * n
    return base or 100 * symbols > 10 * chars or 100 * dups > 30 * lines or not 2 * n <= chars <= 15 * n


def test_host_rules_on_messy_texts(spark):
    docs = messy.documents(spark).unionByName(
        spark.createDataFrame([(40, "a | b\n\na | b\n \na | b & <c>", "s"), (41, "w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 3, "s")], "doc_id long, text string, source string"),
        allowMissingColumns=True,
    )
    for clash in ("_words", "SHRUNK_RATE", "host_docs", "kept", "_host"):
        docs = docs.withColumn(clash, F.lit("clash"))
    judged = judge_hosts(docs, "source")
    assert len({c.lower() for c in judged.columns}) == len(judged.columns)
    got = judged.collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == docs.count()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in got:
        want = brute_measures(texts[r["doc_id"]])
        assert tuple(r[n] for n in names) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r["any_failed"] == brute_any(texts[r["doc_id"]], want)
        assert r["kept"] == (not r["base_failed"] and not r["host_failed"])
    assert judge_hosts(messy.empty(spark), "source").count() == 0


def test_a_bad_host_loses_its_documents_and_usual_ones_keep_theirs(spark):
    good = [(k, messy.prose(k, 60), f"h{k % 20}") for k in range(600)]
    poor = [(1_000 + k, messy.prose(k, 25) + " # | # | # | # | # | # | # | <>" * 4, "junk") for k in range(40)]
    poor += [(2_000 + k, messy.prose(k, 60), "junk") for k in range(10)]
    few = [(3_000, "too short", "new")]
    got = judge_hosts(spark.createDataFrame(good + poor + few, "doc_id long, text string, source string"), "source").collect()
    assert {r["source"] for r in got if r["host_failed"]} == {"junk"}
    assert not any(r["kept"] for r in got if r["source"] == "junk") and all(r["kept"] for r in got if r["source"].startswith("h"))
    rates = {r["source"]: r["shrunk_rate"] for r in got}
    assert rates["junk"] > 0.6 and rates["new"] < 1.0
