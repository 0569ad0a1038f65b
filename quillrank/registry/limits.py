"""Queries of request limits and of answers in pieces."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrank.operators import answers as an
from quillrank.operators import limits as lim
from quillrank.registry import query
from quillrank.sources import views as v
from quillrank.streaming.limits import rate_limit_in_buckets, rate_limit_stream, two_level_stream
from quillrank.streaming import answers as stream_answers
from quillrank.streaming.runs import replay, replay_state

HOUR, DAY = 3_600_000, 86_400_000
LIMITS = [(1, HOUR), (5, DAY)]
SAVE_LIMITS = [(3, HOUR), (10, DAY)]
TOTAL_LIMITS = [(150, DAY)]


def log(spark, sf, amount=None):
    return v.events(spark, sf).select(
        F.col("user_id").alias("client"),
        "now_ms",
        F.col("event_id").alias("id"),
        (F.lit(1).cast("long") if amount is None else amount).alias("amount"),
    )


def fold_sql(first: int, second: int, amount: str) -> str:
    """A request-by-request recursion over each client's log with an hour's and a day's limit."""
    return f"""
    WITH RECURSIVE log AS (SELECT user_id AS client, event_id AS id, now_ms, {amount} AS amount,
        row_number() OVER (PARTITION BY user_id ORDER BY now_ms, event_id) AS rn FROM v_events),
    fold AS (
      SELECT client, rn, id, now_ms, amount, CAST(0 AS BIGINT) AS before1, CAST(0 AS BIGINT) AS before2,
             now_ms + {HOUR} AS end1, now_ms + {DAY} AS end2, true AS passed, CAST(NULL AS BIGINT) AS wait FROM log WHERE rn = 1
      UNION ALL
      SELECT client, rn, id, now_ms, amount, before1, before2, end1, end2, before1 < {first} AND before2 < {second},
             CASE WHEN before1 >= {first} OR before2 >= {second} THEN CAST(ceil(greatest(
               CASE WHEN before1 >= {first} THEN end1 - now_ms ELSE 0 END, CASE WHEN before2 >= {second} THEN end2 - now_ms ELSE 0 END) / 1000) AS BIGINT) END
      FROM (SELECT l.client, l.rn, l.id, l.now_ms, l.amount,
                   CASE WHEN f.end1 <= l.now_ms THEN 0 ELSE f.before1 + CASE WHEN f.passed THEN f.amount ELSE 0 END END AS before1,
                   CASE WHEN f.end2 <= l.now_ms THEN 0 ELSE f.before2 + CASE WHEN f.passed THEN f.amount ELSE 0 END END AS before2,
                   CASE WHEN f.end1 <= l.now_ms THEN l.now_ms + {HOUR} ELSE f.end1 END AS end1,
                   CASE WHEN f.end2 <= l.now_ms THEN l.now_ms + {DAY} ELSE f.end2 END AS end2
            FROM fold f JOIN log l ON l.client = f.client AND l.rn = f.rn + 1))"""


ROWS = " SELECT client, now_ms, id, passed, wait FROM fold"


@query("rate_limit", fold_sql(1, 5, "CAST(1 AS BIGINT)") + ROWS)
def rate_limit(spark, sf):
    return lim.rate_limit(log(spark, sf), LIMITS).select("client", "now_ms", "id", "passed", "wait")


@query("rate_limit_weighted", fold_sql(3, 10, "event_id % 4") + ROWS)
def rate_limit_weighted(spark, sf):
    return lim.rate_limit(log(spark, sf, F.col("event_id") % 4), SAVE_LIMITS).select(
        "client", "now_ms", "id", "passed", "wait"
    )


TWO_LEVEL = fold_sql(1, 5, "CAST(1 AS BIGINT)") + f""",
    survivors AS (SELECT id, now_ms FROM fold WHERE passed),
    opened AS (SELECT min(now_ms) AS s FROM survivors
      UNION ALL SELECT (SELECT min(now_ms) FROM survivors x WHERE x.now_ms >= o.s + {DAY}) FROM opened o
                WHERE EXISTS (SELECT 1 FROM survivors x WHERE x.now_ms >= o.s + {DAY})),
    placed AS (SELECT v.id, v.now_ms, o.s, row_number() OVER (PARTITION BY o.s ORDER BY v.now_ms, v.id) AS n
               FROM survivors v JOIN opened o ON v.now_ms >= o.s AND v.now_ms < o.s + {DAY})
    SELECT f.client, f.now_ms, f.id, CASE WHEN NOT f.passed THEN 'client' WHEN p.n > 150 THEN 'total' END AS refused_by,
           CASE WHEN NOT f.passed THEN f.wait WHEN p.n > 150 THEN CAST(ceil((p.s + {DAY} - p.now_ms) / 1000) AS BIGINT) END AS wait
    FROM fold f LEFT JOIN placed p ON p.id = f.id"""


@query("rate_limit_two_level", TWO_LEVEL)
def rate_limit_two_level(spark, sf):
    return lim.two_level(log(spark, sf), LIMITS, TOTAL_LIMITS)


LIVE = fold_sql(1, 5, "CAST(1 AS BIGINT)") + """
    SELECT client, greatest(arg_max(end1, rn), arg_max(end2, rn)) AS until FROM fold GROUP BY client
    HAVING greatest(arg_max(end1, rn), arg_max(end2, rn)) > (SELECT max(now_ms) - 43200000 FROM v_events)"""


@query("state_expiry", LIVE)
def state_expiry(spark, sf):
    # The last time of the log is one row; half a day before it stands for the present.
    last = v.events(spark, sf).agg(F.max("now_ms").alias("m")).first()["m"]
    return lim.tracked_clients(log(spark, sf), LIMITS, F.lit(last - 43_200_000))


@query("state_expiry_stream", LIVE)
def state_expiry_streamed(spark, sf):
    """The clients that the stream's own state still holds: timers drop the others as the watermark, half a day behind, passes."""
    held = replay_state(log(spark, sf), "now_ms", lambda requests: rate_limit_stream(requests, LIMITS, "12 hours"), "expiry", "windows", 4)
    return held.select("key.client", F.greatest("value.end0", "value.end1").alias("until"))


@query("rate_limit_stream", fold_sql(1, 5, "CAST(1 AS BIGINT)") + ROWS)
def rate_limit_streamed(spark, sf):
    """Several micro-batches in the order of time, so that a client's rows of one are bounded."""
    return replay(log(spark, sf), "now_ms", lambda requests: rate_limit_in_buckets(requests, LIMITS), "rate-limit", 4)


@query("rate_limit_two_level_stream", TWO_LEVEL)
def rate_limit_two_level_streamed(spark, sf):
    return replay(log(spark, sf), "now_ms", lambda requests: two_level_stream(requests, LIMITS, TOTAL_LIMITS), "two-level", 5)


# Answers ---------------------------------------------------------------------------------------


def pieces(spark, sf):
    """Documents in pieces of 50 characters."""
    cut = F.regexp_extract_all("text", F.lit("(?s).{1,50}"), F.lit(0))
    return v.table(spark, sf, "documents").select(
        F.col("doc_id").alias("answer_id"), F.posexplode(cut).alias("seq", "text")
    ).withColumn("seq", F.col("seq").cast("long"))


CAPPED = """
    SELECT answer_id, seq, left(text, 12000 - before) AS text FROM (
      SELECT *, coalesce(CAST(sum(length(text)) OVER (PARTITION BY answer_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before
      FROM v_pieces) WHERE before < 12000 AND text <> ''"""


@query("stream_cap", CAPPED)
def stream_cap(spark, sf):
    return an.stream_cap(pieces(spark, sf))


ASSEMBLED = r"""
    WITH joined AS (SELECT answer_id, regexp_replace(string_agg(text, '' ORDER BY seq), '^\s+|\s+$', '', 'g') AS text FROM v_pieces GROUP BY answer_id)
    SELECT d.doc_id AS answer_id, CASE WHEN d.doc_id % 13 = 0 THEN 'exhausted' WHEN coalesce(j.text, '') = '' THEN 'empty' END AS failed,
           CASE WHEN d.doc_id % 13 <> 0 AND j.text <> '' THEN
             CASE WHEN length(j.text) > 12000 THEN regexp_replace(left(j.text, 12000), '\s+$', '') || '…' ELSE j.text END END AS answer
    FROM documents d LEFT JOIN joined j ON j.answer_id = d.doc_id"""


@query("answer_assembly", ASSEMBLED)
def answer_assembly(spark, sf):
    finish = F.when(F.col("doc_id") % 13 == 0, F.lit("length")).otherwise(F.lit("stop"))
    finishes = v.table(spark, sf, "documents").select(F.col("doc_id").alias("answer_id"), finish.alias("finish"))
    return an.assemble(pieces(spark, sf), finishes)


def ended_pieces(spark, sf):
    """The pieces of documents, the last of each with the reason it ended; a document without text has one empty piece."""
    finish = F.when(F.col("doc_id") % 13 == 0, F.lit("length")).otherwise(F.lit("stop"))
    documents = v.table(spark, sf, "documents").select(F.col("doc_id").alias("answer_id"), "text", finish.alias("finish"))
    cut = F.regexp_extract_all("text", F.lit("(?s).{1,50}"), F.lit(0))
    cut = F.when(F.size(cut) > 0, cut).otherwise(F.array(F.lit("")))
    # The array is a column of its own first: beside a generator it would be cut again for every piece.
    listed = documents.select("answer_id", "finish", F.explode(F.array(cut)).alias("cut"))
    last = F.size("cut") - 1
    numbered = F.transform("cut", lambda text, place: F.struct(place.cast("long").alias("seq"), text.alias("text"), F.when(place == last, F.col("finish")).alias("finish")))
    return listed.select("answer_id", F.inline(numbered))


@query("stream_cap_stream", CAPPED)
def stream_cap_streamed(spark, sf):
    return replay(ended_pieces(spark, sf), "seq", stream_answers.stream_cap, "cap")


@query("answer_assembly_stream", ASSEMBLED)
def answer_assembly_streamed(spark, sf):
    assembled = replay(ended_pieces(spark, sf), "seq", stream_answers.assemble, "assembly")
    return assembled.select("answer_id", "failed", "answer")
