"""Histogram sort against sorting whole, its balance, and its files."""

import zlib

import messy
import pytest
from pyspark.sql import functions as F

from quillrank.llm import histogram_sort as hs


def sizes(rows):
    return [len((r["text"] or "").encode()) + 1 for r in rows]


@pytest.mark.parametrize(("shards", "part_bytes"), [(16, hs.PART_BYTES), (3, 2_000), (1, 500)])
def test_shards_are_ranges_of_one_order(spark, shards, part_bytes):
    docs = messy.documents(spark).withColumn("shard", F.lit("old")).withColumn("SLOT", F.lit(1))
    got = hs.shard_texts(docs, shards=shards, part_bytes=part_bytes).collect()
    assert len(got) == docs.count() and got[0]["SCORE"] == "a"
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(map(str, (r["doc_id"] for r in docs.collect())))
    by_shard = {}
    for r in got:
        by_shard.setdefault(r["shard"], []).append(r)
    assert all(0 <= s < shards for s in by_shard)
    order = []
    for s in sorted(by_shard):
        rows = sorted(by_shard[s], key=lambda r: r["slot"])
        assert [r["slot"] for r in rows] == list(range(len(rows)))
        assert [r["part"] for r in rows] == sorted(r["part"] for r in rows)
        order += rows
    import hashlib

    keys = [(int(hashlib.md5((r["text"] or "").encode()).hexdigest()[:15], 16), -1 if r["doc_id"] is None else r["doc_id"]) for r in order]
    assert keys == sorted(keys)
    largest, share = max(sizes(got)), sum(sizes(got)) / shards
    for s in range(shards):
        assert abs(sum(sizes(by_shard.get(s, []))) - share) <= largest + share / 100


def test_repeated_rows_are_cut_between_rows(spark):
    docs = spark.createDataFrame([(7, "same text")] * 900 + [(k, f"text {k}") for k in range(100)], "doc_id long, text string")
    got = hs.shard_texts(docs, shards=8).groupBy("shard").agg(F.sum(F.length("text") + 1).alias("b"), F.max("slot").alias("m"), F.count("*").alias("n")).collect()
    assert len(got) == 8 and all(r["m"] + 1 == r["n"] for r in got)
    assert max(r["b"] for r in got) - min(r["b"] for r in got) <= 20


def test_equal_texts_stay_together(spark):
    docs = spark.createDataFrame([(k, f"text {k // 3}" + " and more" * 9) for k in range(3_000)], "doc_id long, text string")
    got = hs.shard_texts(docs, shards=4)
    assert got.groupBy("text").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() <= 3
    totals = [r["b"] for r in got.groupBy("shard").agg(F.sum(F.length("text") + 1).alias("b")).collect()]
    assert max(totals) < 1.02 * min(totals)


def test_wide_ids_and_few_rows(spark):
    ids = [-(2**63), 2**63 - 1, 0, None, -1, 5]
    docs = spark.createDataFrame([(i, "") for i in ids], "doc_id long, text string")
    got = hs.shard_texts(docs, shards=3).orderBy("shard", "slot").collect()
    assert [r["doc_id"] for r in got] == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r["shard"] for r in got] == [0, 0, 1, 1, 2, 2]
    assert hs.shard_texts(messy.empty(spark)).count() == 0
    one = hs.shard_texts(docs.limit(1)).collect()
    assert len(one) == 1 and one[0]["slot"] == 0


def test_files_follow_the_slots(spark, tmp_path):
    docs = messy.documents(spark)
    sharded = hs.shard_texts(docs, shards=4, part_bytes=5_000)
    hs.write_shards(sharded, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == docs.count()
    for s in range(4):
        names = sorted((tmp_path / "shards" / f"shard={s}").glob("*.parquet"))
        slots = [r["slot"] for name in names for r in spark.read.parquet(str(name)).collect()]
        assert slots == list(range(len(slots)))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = hs.op11(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(texts)
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["size"] == len(texts[r["doc_id"]].encode()) + 1 for r in got)
