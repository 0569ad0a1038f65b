import hashlib

import messy
import numpy as np
import pyarrow as pa
import pytest

from quillrank.llm import tokens
from quillrank.llm.recompression import anchors, dedup_substrings, op2


def brute(rows, width):
    first: dict[tuple, int] = {}
    for i, text in rows:
        w = messy.words(text)
        for k in range(len(w) - width + 1):
            if i is not None:
                key = tuple(w[k : k + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        w = messy.words(text)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=lambda r: tuple(str(x) for x in r))


@pytest.mark.parametrize("width", [50, 12])
def test_agrees_with_brute_force(spark, width):
    got = dedup_substrings(messy.documents(spark), width=width)
    assert messy.by_row(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute(messy.texts(), width)
    assert {"SCORE", "ids", "_id", "source"} <= set(got.columns)
    for row in got.collect():
        kept = " ".join(messy.words(row["kept_text"]))
        assert hashlib.sha256(kept.encode()).hexdigest() == row["kept_sha256"]
        if row["n_removed"] == 0:
            assert row["kept_text"] == (row["text"] or "")


def test_empty_table(spark):
    assert dedup_substrings(messy.empty(spark)).count() == 0


def test_query_agrees_with_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert messy.by_row(op2(spark, sf), "doc_id", "n_words", "n_removed", "kept_sha256") == brute(rows, 50)


def test_equal_windows_have_equal_anchors_and_few():
    block = messy.prose(11, 300)
    texts = pa.array([messy.prose(k, 40 + k) + " " + block + " " + messy.prose(k + 50, 30) for k in range(12)] + ["a b " * 300])
    found = tokens.Words(*tokens.text_bytes(texts))
    hashes = found.hashes()
    anchor, at = anchors(hashes, found.bounds, 50)
    window, same = tokens.windows(hashes, found.bounds, 50)
    assert (at == same).all()
    by: dict[int, set] = {}
    for w, a in zip(window.tolist(), anchor.tolist(), strict=True):
        by.setdefault(w, set()).add(a)
    assert all(len(a) == 1 for a in by.values())
    assert len(np.unique(anchor)) * 8 < len(np.unique(window))


def test_word_hashes_do_not_depend_on_what_stands_around():
    one = tokens.Words(*tokens.text_bytes(pa.array(["  b\tAB x" + "y" * 9_000, None, "", "\n"])))
    two = tokens.Words(*tokens.text_bytes(pa.array(["AB", "b", "x" + "y" * 9_000])))
    assert one.counts.tolist() == [3, 0, 0, 0]
    assert set(one.hashes().tolist()) == set(two.hashes().tolist())
    assert tokens.Words(*tokens.text_bytes(pa.array(["aB Ab"]))).hashes(lower=True).tolist().count(one.hashes(lower=True)[1]) == 2
