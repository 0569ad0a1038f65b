"""Streams give what the batch jobs give, over several micro-batches."""

import pytest
from pyspark.sql import functions as F

from quillrank.operators import answers, limits, ratings
from quillrank.streaming import answers as stream_answers
from quillrank.streaming import ratings as stream_ratings
from quillrank.streaming import runs
from quillrank.streaming.limits import rate_limit_in_buckets, rate_limit_stream
from quillrank.streaming.runs import run_to_end


def streamed(spark, frame, order, tmp_path, batches=3):
    """The rows as a stream of files, in order of ``order``, one micro-batch each."""
    rows = sorted(frame.collect(), key=lambda r: r[order])
    size = -(-len(rows) // batches)
    for i in range(batches):
        part = spark.createDataFrame(rows[i * size : (i + 1) * size], frame.schema)
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{i}")
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")


@pytest.mark.parametrize("pairs", [[(2, 1_000), (3, 10_000)], [(4, 2_500)]])
def test_rate_limit(spark, tmp_path, pairs):
    # One client has a third of all requests, some at the same time.
    log = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 10).cast("long").alias("client"),
        (F.floor(F.col("id") / 3) * 180).alias("now_ms"),
        "id",
        (F.col("id") % 3).alias("amount"),
    )
    for frame in (log, log.withColumn("amount", F.lit(1).cast("long"))):
        batch = limits.rate_limit(frame, pairs).select("client", "now_ms", "id", "passed", "wait")
        folder = tmp_path / str(frame is log)
        stream = run_to_end(spark, rate_limit_stream(streamed(spark, frame, "id", folder), pairs), "limit-test")
        assert sorted(map(tuple, stream.collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)


TEXTS = ["  hello ", "there", "   ", "", "x" * 30, " ", "tail  "]


def pieces(spark):
    rows = []
    for answer in range(6):
        chosen = TEXTS[: answer + 1] if answer < 5 else ["  ", " "]
        ends = {0: "length"}.get(answer, "stop")
        rows += [(answer, i, t, ends if i == len(chosen) - 1 else None) for i, t in enumerate(chosen)]
    rows += [(9, i, t, "stop" if i == 6 else None) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "answer_id long, seq long, text string, finish string")


@pytest.mark.parametrize("cap", [10, 40, 100])
def test_answers(spark, tmp_path, cap):
    frame = pieces(spark)
    finishes = frame.filter(F.col("finish").isNotNull()).select("answer_id", "finish")
    whole = answers.assemble(frame.drop("finish"), finishes, cap).select("answer_id", "answer", "failed")
    capped = answers.stream_cap(frame.drop("finish"), cap)
    ordered = streamed(spark, frame, "seq", tmp_path, batches=4)
    got = run_to_end(spark, stream_answers.assemble(ordered, cap), "assemble-test")
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))
    got = run_to_end(spark, stream_answers.stream_cap(ordered, cap), "cap-test")
    assert sorted(map(str, got.collect())) == sorted(map(str, capped.collect()))


def test_an_answer_is_trimmed_before_it_is_cut(spark):
    frame = spark.createDataFrame(
        [(1, 0, "a" * 11, "stop"), (2, 0, " " * 20 + "b" * 10 + " " * 20, "stop"), (3, 0, "c" * 10 + " " * 5 + "d", "stop")],
        "answer_id long, seq long, text string, finish string",
    )
    found = answers.assemble(frame.drop("finish"), frame.select("answer_id", "finish"), 10).orderBy("answer_id").collect()
    assert [r.answer for r in found] == ["a" * 10 + "…", "b" * 10, "c" * 10 + "…"]


def test_ratings(spark, tmp_path):
    kinds = ["answer", "source", "reasons", "comment"]
    rows = [
        (
            i % 2,
            0 if i % 3 == 0 else i % 5,
            i,
            kinds[i * 7 % 4],
            ["up", "down", None][i * 5 % 3],
            i % 4,
            f"r{i}",
            f"c{i}" if i % 3 else None,
        )
        for i in range(120)
    ]
    events = spark.createDataFrame(
        rows,
        "user_id long, answer_id long, seq long, kind string, rating string, number long, reasons string, comment string",
    )
    keys = ["user_id", "answer_id"]
    got = run_to_end(spark, stream_ratings.fold_ratings(streamed(spark, events, "seq", tmp_path)), "rating-test")
    last = ratings.latest(got, keys, "seq")
    folded = ratings.fold_ratings(events, keys)
    assert sorted(map(str, last.select(*folded.columns).collect())) == sorted(map(str, folded.collect()))
    sources = last.select(*keys, F.explode("sources").alias("number", "rating"))
    expected = ratings.fold_source_ratings(events, keys)
    assert sorted(map(str, sources.collect())) == sorted(map(str, expected.select(sources.columns).collect()))


def test_a_stream_calls_python_by_buckets_not_by_keys(spark, monkeypatch):
    monkeypatch.setattr(stream_answers, "BUCKETS", 8)
    rows = [(i % 100, i % 3, i, ["answer", "source"][i % 2], ["up", "down", None][i * 5 % 3], i % 4, f"r{i}", None) for i in range(900)]
    schema = "user_id long, answer_id long, seq long, kind string, rating string, number long, reasons string, comment string"
    events, keys = spark.createDataFrame(rows, schema), ["user_id", "answer_id"]
    folder, stream = runs._replayed(events, "seq", stream_ratings.fold_ratings, "bucket-test", 3)
    assert spark.read.format("statestore").load(f"{folder}/checkpoint").count() <= 8
    last = ratings.latest(spark.read.schema(stream.schema).parquet(f"{folder}/rows"), keys, "seq")
    folded = ratings.fold_ratings(events, keys)
    every = events.select(*keys).distinct().join(last, keys, "left")  # nothing is said of answers that stay as they were
    assert sorted(map(str, every.select(*folded.columns).collect())) == sorted(map(str, folded.collect()))


def test_pieces_are_cut_once_for_each_document(spark):
    from quillrank.registry.limits import ended_pieces

    plan = ended_pieces(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan and "regexp_extract_all" not in plan.split("Generate")[0]


def test_limits_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(stream_answers, "BUCKETS", 8)
    log = spark.range(600).select((F.col("id") % 40).alias("client"), (F.floor(F.col("id") / 3) * 180).alias("now_ms"), "id", (F.col("id") % 3).alias("amount"))
    pairs = [(2, 10_000), (3, 30_000)]
    folder, stream = runs._replayed(log, "now_ms", lambda r: rate_limit_in_buckets(r, pairs), "limit-bucket-test", 3)
    assert spark.read.format("statestore").load(f"{folder}/checkpoint").count() <= 8
    columns = ["client", "now_ms", "id", "passed", "wait"]
    got = spark.read.schema(stream.schema).parquet(f"{folder}/rows").select(*columns)
    want = limits.rate_limit(log, pairs).select(*columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
