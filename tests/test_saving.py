"""Typed bodies, and saves that take effect once and whole whenever they are stopped."""

import json

import pytest

from quillrank.functions.fixed_values import RATE_LIMITS
from quillrank.operators import saving as job
from quillrank.operators import validate as val
from quillrank.operators.ratings import feedback_records

T0 = 1_000_000
SAVES = "user_id long, chat_id string, now_ms long, id long, verified boolean, body string"


def chat(n, start=0, title="T", updated=1, **more):
    messages = [{"id": k, "role": "user" if k % 2 == 0 else "assistant", "content": f"m{start}.{k}"} for k in range(n)]
    return json.dumps({"title": title, "updatedAt": updated, "messages": messages, "history": [{"role": "user", "content": " h "}], **more})


def saves(spark, rows):
    return spark.createDataFrame([(u, c, T0 + t, k, ok, body) for k, (u, c, t, ok, body) in enumerate(rows)], SAVES)


def state(store):
    heads = {(r.user_id, r.chat_id): (r.title, r.updated_at, r.message_count) for r in store.read("heads").collect()}
    messages = {(r.user_id, r.chat_id, r.turn): r.message.content for r in store.read("messages").collect()}
    return heads, messages


ROWS = [
    (1, "a", 0, True, chat(4)),
    (1, "a", 1, True, chat(6, 1, "Later", T0 * 9)),  # only two more messages are written, and the clock is clamped
    (1, "b", 2, True, chat(3)),
    (1, "b", 3, True, chat(1, 2)),  # shorter: the rest goes
    (1, "b", 4, True, chat(2, 3)),  # and grows again, with its own message
    (2, "a b", 0, True, chat(1)),
    (2, "a", 0, False, chat(1)),
    (2, "c", 5, True, chat(2, title="")),
    (3, "d", 0, True, chat(5)),
    (3, "e", 1, True, chat(9)),
    (3, "f", 2, True, chat(1)),  # over the limit by now
    (3, "f", 60_000, True, chat(1)),  # the window is over
]
LIMITS = [(12, 10_000), (50, 500_000)]
WANT = [
    ("saved", None), ("saved", None), ("saved", None), ("saved", None), ("saved", None), ("not_found", None), ("unverified", None),
    ("invalid", None), ("saved", None), ("saved", None), ("limited", 10), ("saved", None),
]


def test_saves_of_a_batch_one_after_another(spark, tmp_path):
    store = job.chat_store(spark, str(tmp_path))
    told = job.save_chats(store, saves(spark, ROWS), 0, LIMITS).orderBy("id").collect()
    assert [(r.status, r.wait) for r in told] == WANT
    assert [r.error for r in told if r.error] == ["invalid title"]
    heads, messages = state(store)
    assert heads == {
        (1, "a"): ("Later", T0 + 1, 6), (1, "b"): ("T", 1, 2), (3, "d"): ("T", 1, 5), (3, "e"): ("T", 1, 9), (3, "f"): ("T", 1, 1),
    }
    assert [messages[1, "a", k] for k in range(6)] == ["m0.0", "m0.1", "m0.2", "m0.3", "m1.4", "m1.5"]
    assert {k: m for k, m in messages.items() if k[1] == "b"} == {(1, "b", 0): "m0.0", (1, "b", 1): "m3.1"}
    assert store.read("heads").where("chat_id = 'a'").first().history[0].content == "h"
    # The next batch meets what this one stored, its counts and its windows.
    more = [(1, "a", 5, True, chat(7, 4)), (3, "g", 60_001, True, chat(12)), (3, "g", 60_002, True, chat(13))]
    told = job.save_chats(store, saves(spark, more), 1, LIMITS).orderBy("id").collect()
    assert [(r.status, r.before) for r in told] == [("saved", 6), ("saved", 0), ("limited", 12)]
    heads, messages = state(store)
    assert heads[1, "a"][2] == 7 and messages[1, "a", 6] == "m4.6" and messages[1, "a", 5] == "m1.5" and len(heads) == 6


@pytest.mark.parametrize("stop", ["stage", "mark", "apply"])
def test_a_batch_takes_effect_once_wherever_it_stops(spark, tmp_path, stop):
    class Stopped(Exception):
        pass

    class Broken(job.Store):
        stopping = True

        def _maybe(self, name):
            if self.stopping and name == stop:
                raise Stopped

        def mark(self, batch):
            self._maybe("stage")  # staged, but not marked
            super().mark(batch)
            self._maybe("mark")  # marked, but not applied

        def apply(self, batch):
            super().apply(batch)
            self._maybe("apply")

    store = Broken(spark, str(tmp_path / "broken"), {"heads": job.HEADS, "messages": job.MESSAGES, "windows": job.WINDOWS}, job.DECISIONS)
    with pytest.raises(Stopped):
        job.save_chats(store, saves(spark, ROWS), 0, LIMITS)
    if stop == "stage":
        assert state(store) == ({}, {})
    store.stopping = False
    told = job.save_chats(store, saves(spark, ROWS), 0, LIMITS).orderBy("id").collect()
    assert [(r.status, r.wait) for r in told] == WANT
    once = state(store)
    job.save_chats(store, saves(spark, ROWS), 0, LIMITS)
    assert state(store) == once
    whole = job.chat_store(spark, str(tmp_path / "whole"))
    job.save_chats(whole, saves(spark, ROWS), 0, LIMITS)
    assert state(whole) == once


def test_feedback_is_kept_once_for_each_answer(spark, tmp_path):
    body = {"question": "q", "answer": "a", "rating": "down", "sources": [{"id": "s", "cited": True, "rating": None}]}
    rows = [(1, "c-1", k, True, json.dumps({**body, "comment": f" {k} "})) for k in range(3)]
    rows += [(1, "c-2", 3, True, json.dumps({**body, "rating": "up", "reasons": ["unclear"]})), (2, "c-1", 0, False, json.dumps(body)), (2, "c 1", 0, True, json.dumps(body))]
    rows += [(1, "c-3", 4, True, json.dumps(body))]
    sent = spark.createDataFrame([(u, c, T0 + t, k, ok, b) for k, (u, c, t, ok, b) in enumerate(rows)], SAVES.replace("chat_id", "feedback_id"))
    store = job.feedback_store(spark, str(tmp_path))
    for _ in range(2):
        told = job.save_feedback(store, sent, 0, [(4, 60_000)]).orderBy("id").collect()
        assert [r.status for r in told] == ["saved", "saved", "saved", "invalid", "unverified", "not_found", "limited"]
        (kept,) = store.read("feedback").collect()
        assert (kept.feedback_id, kept.comment, kept.rating, kept.reasons, kept.sources[0].rating) == ("c-1", "2", "down", [], None)
    assert RATE_LIMITS["feedback"]


def test_typed_rows(spark):
    turn = {"role": "user", "content": " hi "}
    rows = [
        json.dumps({"message": " m ", "history": [turn, {"role": "assistant", "content": "x"}], "summary": " s ", "symptoms": [" a ", "b"]}),
        json.dumps({"message": "m"}),
        json.dumps({"message": 3}),
        None,
    ]
    found = val.valid_requests(spark.createDataFrame([(k, b) for k, b in enumerate(rows)], "id long, body string")).orderBy("id").collect()
    assert [(r.id, r.message, r.summary, r.symptoms, r.diseases) for r in found] == [(0, "m", "s", ["a", "b"], None), (1, "m", None, None, None)]
    assert [tuple(t) for t in found[0].history] == [("user", "hi"), ("assistant", "x")] and found[1].history == []
    source = {"id": "i", "bookId": "b", "bookTitle": "B", "author": None, "remedyName": "R", "sectionTitle": "S", "passageIndexes": [0, 7], "text": "x"}
    body = {"title": "T", "updatedAt": 5, "messages": [{"id": 0, "role": "user", "content": "c", "sources": [source]}, {"id": 1, "role": "assistant", "content": "d"}], "history": [], "summary": " s "}
    (row,) = val.valid_chats(spark.createDataFrame([(json.dumps(body),)], "body string")).collect()
    assert (row.title, row.updated_at, row.history, row.summary) == ("T", 5, [], " s ")
    assert row.messages[1].sources is None
    (kept,) = row.messages[0].sources
    assert (kept.author, kept.remedy_name, kept.passage_indexes) == (None, "R", [0, 7])


def test_records_of_rated_answers(spark):
    answers = spark.createDataFrame([(1, 1, "Yes [2].", "Q?"), (1, 3, "No.", "Really?")], "chat_id long, turn long, answer string, question string")
    sources = spark.createDataFrame([(1, 1, 1, "s1"), (1, 1, 2, "s2")], "chat_id long, turn long, number long, id string")
    main = spark.createDataFrame([(1, 1, "down", ["unclear"], "c")], "chat_id long, turn long, rating string, reasons array<string>, comment string")
    rated = spark.createDataFrame([(1, 1, 2, "up")], "chat_id long, turn long, number long, rating string")
    first, second = feedback_records(answers, sources, main, rated, ["chat_id", "turn"]).orderBy("turn").collect()
    assert [tuple(s) for s in first.sources] == [("s1", False, None), ("s2", True, "up")] and first.reasons == ["unclear"]
    assert (second.rating, second.sources, second.reasons, second.comment) == (None, [], [], None)
