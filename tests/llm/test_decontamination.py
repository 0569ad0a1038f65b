import hashlib
import re

import messy
import pytest

from quillrank.llm.decontaminate import decontaminate, op7


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", messy.lower(text))


def brute(rows, items, width=10):
    wanted: dict = {}
    for i, text in items:
        w = plain(text)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            wanted.setdefault(tuple(w[k : k + width]), set()).add(str(i))
    out = []
    for i, text in rows:
        w, hit, ids = plain(text), set(), set()
        for size in {len(k) for k in wanted}:
            for k in range(len(w) - size + 1):
                if (found := wanted.get(tuple(w[k : k + size]))) is not None:
                    hit.update(range(k, k + size))
                    ids |= found
        out.append((i, len(w), len(hit), sorted(ids)))
    return sorted(out, key=lambda r: tuple(str(x) for x in r))


@pytest.mark.parametrize("block", [1_000_000, 7])
def test_agrees_with_brute_force(spark, block):
    docs = messy.documents(spark).unionByName(
        spark.createDataFrame([(30, "é! ONE, two... Three? " + messy.prose(3, 30).replace(" ", " -- ") + " ß", "en")], "doc_id long, text string, lang string"),
        allowMissingColumns=True,
    )
    bench = messy.benchmark(spark)
    got = decontaminate(docs, bench, block=block)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert messy.by_row(got, "doc_id", "n_words", "n_hit", "items") == brute(rows, [tuple(r) for r in bench.collect()])
    for row in got.collect():
        again = [w for a, b in row["hit_spans"] for w in plain(row["text"][a:b])]
        assert len(again) == row["n_hit"]
    assert {"SCORE", "ids", "source"} <= set(got.columns)


def test_empty_tables(spark):
    bench = messy.benchmark(spark)
    assert decontaminate(messy.empty(spark), bench).count() == 0
    clean = decontaminate(messy.documents(spark), bench.limit(0))
    assert {(r["n_hit"], len(r["items"])) for r in clean.collect()} == {(0, 0)}


def test_query_agrees_with_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*c).collect()]
    want = [
        (i, n, h, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), h > 0)
        for i, n, h, ids in brute(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))
    ]
    got = messy.by_row(op7(spark, sf), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(want, key=lambda r: tuple(str(x) for x in r))
