"""Payloads, rubrics, catalogs and replies: what is read, what is an error, what is asked again."""

import json
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillrank.operators import chats as ch
from quillrank.operators.replies import ReplyStore
from quillrank.plans.repertorise import remedy_rows
from quillrank.sources import passages as src

PAYLOAD = "book_id string, id long, chunk_id string, source_title string, content string, chunk_index string, embedding array<double>"


def payloads(spark, n=400):
    rows = [(f"b{k % 3}", k, f"c{k}", "Title", "text " * 50, str(k % 9), [1.0]) for k in range(n)]
    return spark.createDataFrame(rows, PAYLOAD)


def test_winners_prune_the_folders_and_shuffle_no_payload(spark, tmp_path):
    path = str(tmp_path / "payloads")
    src.store_payloads(payloads(spark), path, 32)
    best = spark.createDataFrame([(1, "b1", 4), (1, "b2", 5), (2, "b1", 4)], "query_id long, book_id string, id long")
    found = src.fetch_stored(best, path, 32)
    rows = found.collect()
    assert sorted((r.query_id, r.id, r.chunk_id) for r in rows) == [(1, 4, "c4"), (1, 5, "c5"), (2, 4, "c4")]
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    scan = plan.split("FileScan parquet")[1]
    assert "bucket#" in scan.split("PartitionFilters:")[1].split("]")[0] and " IN (" in scan and "embedding" not in scan
    assert len(re.search(r"bucket#\d+ IN \(([\d,]+)\)", scan)[1].split(",")) == 2  # of 32 folders
    # Between the payloads and the join with their winners there is no exchange.
    lines = plan.split("\n")
    at = next(k for k, line in enumerate(lines) if "FileScan parquet" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-|*("))
    above = [line for line in lines[:at] if depth(line) < depth(lines[at])]
    inner = max(k for k, line in enumerate(above) if "Join" in line)
    assert not any("Exchange hashpartitioning" in line for line in above[inner:])
    assert src.fetch_stored(best.withColumn("id", F.col("id") + 10_000), path, 32, strict=False).where("chunk_id IS NULL").count() == 3


@pytest.mark.parametrize(
    ("change", "error"),
    [
        ({"chunk_id": None}, "no chunk_id"),
        ({"source_title": None}, "no source_title"),
        ({"content": None}, "no content"),
        ({"chunk_index": None}, "no integer chunk_index"),
        ({"chunk_index": "1.5"}, "no integer chunk_index"),
    ],
)
def test_a_winner_without_a_whole_payload_is_an_error(spark, change, error):
    kinds = {"chunk_index": "string"}
    broken = payloads(spark, 9).withColumns({name: F.when(F.col("id") == 4, F.lit(x).cast(kinds.get(name, "string"))).otherwise(F.col(name)) for name, x in change.items()})
    best = spark.createDataFrame([(1, "b1", 4)], "query_id long, book_id string, id long")
    with pytest.raises(PySparkException, match=f"b1/4 has {error}"):
        src.fetch_payloads(best, broken).collect()
    other = spark.createDataFrame([(1, "b2", 5)], "query_id long, book_id string, id long")
    assert src.fetch_payloads(other, broken).count() == 1
    with pytest.raises(PySparkException, match="no payload for passage b1/77"):
        src.fetch_payloads(best.withColumn("id", F.lit(77).cast("long")), broken).collect()


def test_matched_rubrics_must_be_whole(spark):
    schema = "book_id string, id string, chapter string, text string, remedies array<struct<remedy_id: string, grade: int>>"
    rubrics = spark.createDataFrame([("r", "1", "c", "t", [("x", 1)]), ("r", "2", "c", "t", [("x", None)]), ("r", "3", "c", None, [("x", 1)])], schema)
    matches = lambda i: spark.createDataFrame([(1, 1, 1, "r", i)], "case_id long, symptom_ord long, rubric_ord long, book_id string, rubric_id string")
    assert [(r.remedy_id, r.grade) for r in remedy_rows(matches("1"), rubrics).collect()] == [("x", 1)]
    for number, problem in (("2", "no grade"), ("3", "no text")):
        with pytest.raises(PySparkException, match=f"rubric {number}: {problem}"):
            remedy_rows(matches(number), rubrics).collect()


def test_an_empty_or_broken_catalog_is_an_error(spark):
    terms = spark.createDataFrame([("fever", ["a"])], "text string, remedies array<string>")
    assert src.catalog_of(terms).count() == 1
    with pytest.raises(ValueError, match="no clinical terms"):
        src.catalog_of(terms.limit(0))
    with pytest.raises(PySparkException, match="invalid clinical term"):
        src.catalog_of(terms.withColumn("remedies", F.array(F.lit(None).cast("string")))).collect()


def test_only_unanswered_prompts_are_asked_again(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()
    path = str(log)

    def generate(prompts):
        import os
        import uuid

        if any("bad" in p for p in prompts):
            raise ValueError("no")
        for p in prompts:
            with open(os.path.join(path, uuid.uuid4().hex), "w") as out:
                out.write(p)
        return [p.upper() for p in prompts]

    def asked():
        return sorted(f.read_text() for f in log.iterdir())

    store = ReplyStore(spark, str(tmp_path / "store"), attempts=2)
    prompts = spark.createDataFrame([(1, "one"), (2, "two"), (3, "two"), (4, "bad")], "id long, text string")
    first = {r.id: (r.reply, r.error, r.attempt) for r in store.ask(prompts, "id", generate, wrap=None).collect()}
    assert first == {1: ("ONE", None, 1), 2: ("TWO", None, 1), 3: ("TWO", None, 1), 4: (None, "ValueError: no", 1)}
    assert asked() == ["one", "two"]
    more = prompts.unionByName(spark.createDataFrame([(5, "three")], "id long, text string"))
    second = {r.id: r.attempt for r in store.ask(more, "id", generate, wrap=None).collect()}
    assert second == {1: 1, 2: 1, 3: 1, 4: 2, 5: 1} and asked() == ["one", "three", "two"]
    runs = store.runs()
    assert store.ask(more, "id", generate, wrap=None).count() == 5  # attempts are used up: nothing is asked
    assert store.runs() == runs and asked() == ["one", "three", "two"]


def test_archives_keep_everything(spark):
    source = {"id": "i", "bookId": "b", "bookTitle": "B", "author": None, "remedyName": None, "sectionTitle": "S", "passageIndexes": [3], "text": "x"}
    chat = {"id": "a", "title": "T", "updatedAt": 7, "messages": [{"id": 0, "role": "user", "content": "q"}, {"id": 1, "role": "assistant", "content": "r", "sources": [source]}], "history": [{"role": "user", "content": "h"}], "summary": "s", "later": {"x": [1, None]}}
    odd = {"id": "o", "title": "O", "updatedAt": 9, "messages": [5, {"id": "x"}], "history": []}
    rows = spark.createDataFrame([(1, json.dumps([chat, odd, 4]))], "archive_id long, archive string")
    first, second = ch.whole_archives(rows).orderBy("place").collect()
    assert (first.chat_id, first.messages[0].id, first.messages[0].role) == ("o", None, None)
    assert second.messages[1].sources[0].passage_indexes == [3] and second.messages[0].sources is None
    assert (second.summary, second.history[0].content) == ("s", "h")
    assert json.loads(second.entry) == chat and json.loads(first.entry) == odd
