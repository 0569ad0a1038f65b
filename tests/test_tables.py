"""Chats, feedback, validation and limits on known results."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from quillrank.operators import chats as ch
from quillrank.operators import limits as lim
from quillrank.operators import ratings as rt
from quillrank.operators import validate as val
from quillrank.sources import passages as src

MESSAGE = "chat_id long, turn long, role string, text string, status string"


def test_saved_messages(spark):
    rows = [
        (1, 0, "user", "First?", None),
        (1, 1, "assistant", "Answer [1].", None),
        (1, 2, "user", "Failed?", None),
        (1, 3, "assistant", "", "error"),
        (1, 4, "user", "Stopped?", None),
        (1, 5, "assistant", "Part", "stopped"),
    ]
    frame = spark.createDataFrame(rows, MESSAGE)
    assert sorted(r.turn for r in ch.saved_messages(frame).collect()) == [0, 1, 4, 5]
    assert [(r.turn, r.question) for r in ch.rateable_answers(frame).collect()] == [(1, "First?")]
    assert ch.chat_titles(frame).first()["title"] == "First?"


def test_age_groups(spark):
    def at(days, hour=9):
        return int(datetime(2026, 11, 2, hour, tzinfo=timezone.utc).timestamp() * 1000) - days * 86_400_000

    rows = [(1, i, "t", u) for i, u in enumerate([at(0), at(1, 23), at(3), at(30)])]
    listed = ch.list_chats(spark.createDataFrame(rows, "user_id long, chat_id long, title string, updated_at long"))
    found = ch.age_groups(listed, at(0, 15)).orderBy("place").collect()
    assert [(r.label, r.run) for r in found] == [("Today", 1), ("Yesterday", 2), ("Previous 7 days", 3), ("Older", 4)]


def test_save_delta_never_rewrites(spark):
    heads = spark.createDataFrame([(1, 3), (2, 5)], "chat_id long, message_count long")
    stored = spark.createDataFrame([(1, i) for i in range(3)] + [(2, i) for i in range(5)], "chat_id long, turn long")
    incoming = spark.createDataFrame(
        [(1, i) for i in range(5)] + [(2, i) for i in range(2)] + [(3, 0)], "chat_id long, turn long"
    )
    found = {(r.chat_id, r.turn, r.action) for r in ch.save_delta(heads, stored, incoming).collect()}
    assert found == {(1, 3, "set"), (1, 4, "set"), (2, 2, "delete"), (2, 3, "delete"), (2, 4, "delete"), (3, 0, "set")}
    assert {(r.chat_id, r.written) for r in ch.new_messages(heads, incoming).collect()} == {(1, 2), (2, 0), (3, 1)}


def test_archives(spark):
    good = {"id": "ok", "title": "T", "updatedAt": 1, "messages": [], "history": []}
    newer = {**good, "id": "new", "updatedAt": 2}
    rows = [(1, json.dumps([{"id": 1}, good, {**good, "id": 5}, newer, 7])), (2, "{nope"), (3, json.dumps(good)), (4, None)]
    found = ch.read_archives(spark.createDataFrame(rows, "archive_id long, archive string")).orderBy("place").collect()
    assert [(r.archive_id, r.chat_id) for r in found] == [(1, "new"), (1, "ok")]


def test_retain_newest(spark):
    schema = "user_id long, chat_id long, updated_at long, bytes long"
    rows = [(1, i, i, 10) for i in range(60)] + [(2, 0, 1, 500), (2, 1, 2, 500)] + [(3, 0, 1, 5_000)]
    found = ch.retain_newest(spark.createDataFrame(rows, schema), quota=600).collect()
    assert sorted(r.chat_id for r in found if r.user_id == 1) == list(range(10, 60))
    assert [r.chat_id for r in found if r.user_id == 2] == [1]
    assert [(r.chat_id, r.too_large) for r in found if r.user_id == 3] == [(0, True)]


def test_feedback_ids_with_dashes(spark):
    rows = [("a-1",), ("a-b-2",), ("a-b-x",), ("a-",)]
    found = rt.split_feedback_id(spark.createDataFrame(rows, "feedback_id string")).collect()
    assert {(r.chat_id, r.message_id) for r in found} == {("a", 1), ("a-b", 2)}


def test_required_fields_and_embeddings(spark):
    raw = spark.createDataFrame([("a", "1"), (None, "1"), ("a", "x"), ("a", None), ("a", "1.5")], "t string, n string")
    found = [r.problem for r in src.check_required(raw, ["t"], ["n"]).collect()]
    assert found == [None, "no t", "no integer n", "no integer n", "no integer n"]
    texts = spark.createDataFrame([(0,), (1,), (2,), (3,)], "i long")
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (2, [1.0, None])], "i long, embedding array<double>")
    problems = src.attach_embeddings(texts, vectors, ["i"], 2).orderBy("i").collect()
    assert [r.problem for r in problems] == [None, "wrong dimensions", "not numeric", "no embedding"]


def test_a_winner_without_payload_is_an_error(spark):
    best = spark.createDataFrame([("b", 1), ("b", 2)], "book_id string, id long")
    payload = spark.createDataFrame([("b", 1, "c1")], "book_id string, id long, chunk_id string")
    assert src.fetch_payloads(best, payload, strict=False).count() == 2
    with pytest.raises(Exception, match="no payload for passage b/2"):
        src.fetch_payloads(best, payload).collect()


A = "a"
REQUESTS = [
    ({"message": "  "}, "message must not be blank"),
    ({"message": A * 4_001}, "message must not exceed 4000 characters"),
    ({"message": 42}, "message must be a string"),
    ({}, "message must be a string"),
    ({"message": "q", "bookIds": ["b"]}, "unexpected request field"),
    ({"message": "q", "history": [{"role": "system", "content": "h"}]}, 'role must be "user" or "assistant"'),
    ({"message": "q", "history": [{"role": "user", "content": A}] * 21}, "history must not exceed 20 turns"),
    ({"message": "q", "history": [{"role": "user", "content": A * 4_000}] * 5}, "history must not exceed 16000 characters"),
    ([], "invalid request"),
    ({"message": "q", "symptoms": ["s"] * 16}, "symptoms must not exceed 15"),
    ({"message": "q", "symptoms": [" " * 300 + A * 200]}, None),
    ({"message": "q", "symptoms": [A * 201]}, "a symptom must not exceed 200 characters"),
    ({"message": "q", "diseases": []}, None),
    ({"message": "q", "summary": None}, "summary must be a string"),
    ({"message": "", "summary": ""}, "message must not be empty"),
]


def test_validate_requests(spark):
    rows = [(i, json.dumps(body)) for i, (body, _) in enumerate(REQUESTS)] + [(99, '{"message":'), (100, None)]
    found = val.validate_requests(spark.createDataFrame(rows, "i long, body string")).orderBy("i").collect()
    assert [r.error for r in found[:-2]] == [error for _, error in REQUESTS]
    assert {r.error for r in found[-2:]} == {"request body must be valid JSON"}
    passed, aside = val.split(val.validate_requests(spark.createDataFrame(rows, "i long, body string")))
    assert (passed.count(), aside.count()) == (2, 15)


FEEDBACK = {"question": "q", "answer": "a", "rating": "down", "sources": []}


@pytest.mark.parametrize(
    ("change", "error", "comment"),
    [
        ({"reasons": ["unclear"], "comment": " so "}, None, "so"),
        ({"comment": "  "}, None, None),
        ({"reasons": ["unclear", "unclear"]}, "reasons must not repeat", None),
        ({"rating": "up", "reasons": ["unclear"]}, "only an answer rated down has reasons", None),
        ({"rating": None}, None, None),
        ({"comment": A * 1_001}, "comment must not exceed 1000 characters", None),
        ({"mood": 1}, "unexpected feedback field", None),
    ],
)
def test_validate_feedback(spark, change, error, comment):
    row = spark.createDataFrame([(json.dumps({**FEEDBACK, **change}),)], "body string")
    found = val.validate_feedback(row).first()
    assert (found.error, found.comment) == (error, comment)


LIMITS = [(2, 1_000), (3, 10_000)]


def waits(spark, events, limits=LIMITS):
    log = spark.createDataFrame([(c, t, i, a) for i, (c, t, a) in enumerate(events)], "client string, now_ms long, id long, amount long")
    return [r.wait for r in lim.rate_limit(log, limits).orderBy("id").collect()]


def test_limits_within_every_window(spark):
    events = [("a", 0, 1)] * 3 + [("b", 0, 1), ("a", 1_000, 1), ("a", 2_000, 1), ("a", 10_000, 1)]
    assert waits(spark, events) == [None, None, 1, None, None, 8, None]
    assert waits(spark, [("a", 0, 1)] * 4 + [("a", 1_000, 1)]) == [None, None, 1, 1, None]


def test_limits_by_amount(spark):
    events = [("a", 0, 2), ("a", 0, 0), ("b", 0, 0), ("a", 1_000, 5), ("a", 1_000, 0)]
    assert waits(spark, events) == [None, 1, None, None, 9]
    # Requests that count nothing pass however many there are at one time.
    assert waits(spark, [("a", 0, 0)] * 50) == [None] * 50


def test_the_total_is_not_used_by_refused_clients(spark):
    log = spark.createDataFrame([(c, 0, i, 1) for i, c in enumerate("aaabbc")], "client string, now_ms long, id long, amount long")
    found = lim.two_level(log, [(2, 1_000)], [(4, 10_000)]).orderBy("id").collect()
    assert [r.refused_by for r in found] == [None, None, "client", None, None, "total"]


def test_idle_clients_are_forgotten(spark):
    log = spark.createDataFrame([("a", 0, 0, 1), ("b", 500, 1, 1)], "client string, now_ms long, id long, amount long")
    assert [r.client for r in lim.tracked_clients(log, [(1, 1_000)], F.lit(1_000)).collect()] == ["b"]


def test_apply_delta(spark):
    heads = spark.createDataFrame([(1, 2), (2, 3)], "chat_id long, message_count long")
    columns = "chat_id long, turn long, text string"
    stored = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "x"), (2, 1, "y"), (2, 2, "z"), (4, 0, "other")], columns)
    incoming = spark.createDataFrame([(1, 0, "changed"), (1, 1, "b"), (1, 2, "c"), (2, 0, "x")], columns)
    after = ch.apply_delta(stored, incoming, ch.save_delta(heads, stored, incoming))
    assert sorted(map(tuple, after.collect())) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "x"), (4, 0, "other")]


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_a_chats_feedback_is_read_by_its_prefix(spark, tmp_path):
    rows = [("a-1",), ("a-b-2",), ("ab-3",), ("a-x",)]
    spark.createDataFrame(rows, "feedback_id string").write.parquet(f"{tmp_path}/f")
    found = rt.feedback_of_chat(spark.read.parquet(f"{tmp_path}/f"), "a")
    assert [(r.chat_id, r.message_id) for r in found.collect()] == [("a", 1)]
    assert "StringStartsWith(feedback_id,a-)" in plan_of(found)


def test_books_are_read_by_their_folder(spark, tmp_path):
    rows = [("b1", 1, "x"), ("b2", 2, "y"), ("b2", 3, "z")]
    src.write_passages(spark.createDataFrame(rows, "book_id string, id long, content string"), f"{tmp_path}/p")
    found = src.read_passages(spark, f"{tmp_path}/p", ["b2"]).select("id")
    assert sorted(r.id for r in found.collect()) == [2, 3]
    plan = plan_of(found)
    assert "PartitionFilters: [isnotnull(book_id" in plan and "ReadSchema: struct<id:bigint>" in plan


def test_top_k_is_cut_before_the_shuffle(spark):
    from quillrank.operators.ordered import top_k

    frame = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    plan = plan_of(top_k(frame, ["g"], [F.col("id").asc()], 5))
    assert plan.count("WindowGroupLimit") == 2


def test_ids_and_integers_end_where_the_text_ends(spark):
    frame = spark.createDataFrame([("abc", True), ("abc\n", False), ("a b", False), ("x" * 65, False)], "id string, fine boolean")
    assert all(r["v"] == r["fine"] for r in frame.select(ch.valid_id(F.col("id")).alias("v"), "fine").collect())
    raw = spark.createDataFrame([("c", "7"), ("c", "7\n"), ("c", "-12")], "chunk_id string, chunk_index string")
    problems = [r["problem"] for r in src.check_required(raw, ["chunk_id"], ["chunk_index"]).collect()]
    assert problems == [None, "no integer chunk_index", None]


def test_a_saved_chat_comes_first(spark):
    rows = [(1, k, k * 10, 5) for k in range(6)]
    frame = spark.createDataFrame(rows, "user_id long, chat_id long, updated_at long, bytes long")
    kept = ch.retain_newest(frame, quota=15, saved=F.col("chat_id") == 2).orderBy("place").collect()
    assert [r["chat_id"] for r in kept] == [2, 5, 4]
    assert [r["chat_id"] for r in ch.retain_newest(frame, quota=15).orderBy("place").collect()] == [5, 4, 3]


def test_comments_are_trimmed(spark):
    rows = [(1, 1, 1, "comment", None, None, "  hi  "), (1, 2, 1, "comment", None, None, "x"), (1, 2, 2, "comment", None, None, " \n ")]
    events = spark.createDataFrame(rows, "user_id long, answer_id long, seq long, kind string, rating string, reasons string, comment string")
    found = {r["answer_id"]: r["comment"] for r in rt.fold_ratings(events, ["user_id", "answer_id"]).collect()}
    assert found == {1: "hi", 2: None}


def test_total_limit_is_a_fold_without_one_task(spark):
    rows = [(f"c{k % 7}", (k * 37) // 3, k, k % 3) for k in range(400)]
    log = spark.createDataFrame(rows, "client string, now_ms long, id long, amount long")
    found = lim.two_level(log, [(10**6, 10**9)], [(9, 500)])
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: (r["refused_by"], r["wait"]) for r in found.collect()}
    count, end = 0, None
    for _, now, number, amount in sorted(rows, key=lambda r: (r[1], r[2])):
        if end is None or now >= end:
            count, end = 0, now + 500
        refused = count >= 9
        assert got[number] == (("total", -(-(end - now) // 1000)) if refused else (None, None))
        count += 0 if refused else amount
