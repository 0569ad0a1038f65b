"""Queries of typed bodies, of saving as whole jobs, and of the record kept for a rated answer."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillrank.operators import chats as ch
from quillrank.operators import ratings as rt
from quillrank.operators import saving as job
from quillrank.operators import validate as val
from quillrank.registry import ORACLES, query, validation
from quillrank.sources import views as v
from quillrank.sources.bodies import CHATS, COMPACTS, FEEDBACK, REQUESTS, bodies, bodies_sql
from quillrank.sources.shared import shared_folder

HOUR, DAY = 3_600_000, 86_400_000
START = 1_700_000_000_000
SAVE_LIMITS = [(6, HOUR), (20, DAY)]
RATE_LIMITS = [(3, HOUR), (9, DAY)]
STRIP = validation.STRIP


def valid_sql(kind: str, templates: list[str], columns: str) -> str:
    """The bodies without an error, by the SQL of their rules."""
    return f"""WITH errors AS ({ORACLES[kind]}), b AS ({bodies_sql(templates)}),
    p AS (SELECT conv_id, turn, CAST(body AS JSON) AS v FROM b JOIN (SELECT conv_id, turn FROM errors WHERE error IS NULL) USING (conv_id, turn))
    SELECT conv_id, turn, {columns} FROM p"""


def listed(path: str, each: str) -> str:
    return f"list_transform(CAST(json_extract(v, '$.{path}') AS JSON[]), lambda t: {each})"


def stripped(path: str, value: str = "v") -> str:
    return STRIP.format(x=f"json_extract_string({value}, '$.{path}')")


TURN = "json_extract_string(t, '$.role') || ': ' || " + stripped("content", "t")
HISTORY_SQL = f"coalesce(array_to_string({listed('history', TURN)}, '|'), '') AS history"


def history():
    return F.array_join(F.transform("history", lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "|").alias("history")


CONFIRMED = STRIP.format(x="json_extract_string(t, '$')")


@query("valid_requests", valid_sql("validate_requests", REQUESTS, f"""{stripped("message")} AS message, {HISTORY_SQL}, {stripped("summary")} AS summary,
    array_to_string({listed("symptoms", CONFIRMED)}, '|') AS symptoms, array_to_string({listed("diseases", CONFIRMED)}, '|') AS diseases"""))
def valid_requests(spark, sf):
    found = val.valid_requests(bodies(spark, sf, REQUESTS))
    lists = [F.array_join(c, "|").alias(c) for c in ("symptoms", "diseases")]
    return found.select("conv_id", "turn", "message", history(), "summary", *lists)


@query("valid_compacts", valid_sql("validate_compact", COMPACTS, f"{HISTORY_SQL}, {stripped('summary')} AS summary"))
def valid_compacts(spark, sf):
    return val.valid_compacts(bodies(spark, sf, COMPACTS)).select("conv_id", "turn", history(), "summary")


CITATION_SQL = "array_to_string(list_transform(CAST(json_extract(t, '$.sources') AS JSON[]), lambda s: json_extract_string(s, '$.id') || '/' || coalesce(json_extract_string(s, '$.author'), '-') || '/' || json_extract_string(s, '$.remedyName') || '/' || array_to_string(CAST(json_extract(s, '$.passageIndexes') AS BIGINT[]), '+') || '/' || json_extract_string(s, '$.bookTitle') || json_extract_string(s, '$.sectionTitle') || json_extract_string(s, '$.text')), ',')"
MESSAGE_SQL = f"json_extract_string(t, '$.id') || ' ' || json_extract_string(t, '$.role') || ': ' || json_extract_string(t, '$.content') || ' ' || coalesce({CITATION_SQL}, 'none')"


def messages_text():
    def source(s):
        indexes = F.array_join(F.transform(s["passage_indexes"], lambda i: i.cast("string")), "+")
        parts = [s["id"], F.coalesce(s["author"], F.lit("-")), s["remedy_name"], indexes, F.concat(s["book_title"], s["section_title"], s["text"])]
        return F.concat_ws("/", *parts)

    def message(m):
        sources = F.coalesce(F.array_join(F.transform(m["sources"], source), ","), F.lit("none"))
        return F.concat(m["id"].cast("string"), F.lit(" "), m["role"], F.lit(": "), m["content"], F.lit(" "), sources)

    return F.array_join(F.transform("messages", message), "|").alias("messages")


@query("valid_chats", valid_sql("validate_chats", CHATS, f"""json_extract_string(v, '$.title') AS title, CAST(json_extract(v, '$.updatedAt') AS BIGINT) AS updated_at,
    array_to_string({listed("messages", MESSAGE_SQL)}, '|') AS messages, {HISTORY_SQL}, json_extract_string(v, '$.summary') AS summary"""))
def valid_chats(spark, sf):
    found = val.valid_chats(bodies(spark, sf, CHATS))
    return found.select("conv_id", "turn", "title", "updated_at", messages_text(), history(), "summary")


RATED_SQL = "json_extract_string(t, '$.id') || '/' || json_extract_string(t, '$.cited') || '/' || coalesce(json_extract_string(t, '$.rating'), '-')"


@query("valid_feedback", valid_sql("validate_feedback", FEEDBACK, f"""json_extract_string(v, '$.question') AS question, json_extract_string(v, '$.answer') AS answer,
    json_extract_string(v, '$.rating') AS rating, array_to_string({listed("sources", RATED_SQL)}, ',') AS sources,
    coalesce(array_to_string({listed("reasons", "json_extract_string(t, '$')")}, ','), '') AS reasons, nullif({stripped("comment")}, '') AS comment"""))
def valid_feedback(spark, sf):
    found = val.valid_feedback(bodies(spark, sf, FEEDBACK))
    source = F.transform("sources", lambda s: F.concat_ws("/", s["id"], s["cited"].cast("string"), F.coalesce(s["rating"], F.lit("-"))))
    return found.select("conv_id", "turn", "question", "answer", "rating", F.array_join(source, ",").alias("sources"), F.array_join("reasons", ",").alias("reasons"), "comment")


# Saving ------------------------------------------------------------------------------------------


def chat_saves(spark, sf):
    """Each conversation as a chat that one of forty users saves, ten minutes after the one before."""
    # More messages than a chat may have make it invalid, so no more than one over are gathered.
    turns = v.turns(spark, sf).where("turn <= 400").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("turn").alias("id"), "role", F.col("text").alias("content")))).alias("messages")
    )
    now = F.lit(START) + F.col("conv_id") * 600_000
    placed = turns.withColumn("now_ms", now)
    title = F.when(F.col("conv_id") % 9 == 4, F.lit("")).otherwise(F.concat(F.lit("T"), F.col("conv_id").cast("string")))
    body = F.to_json(
        F.struct(
            title.alias("title"),
            (F.col("now_ms") + (F.col("conv_id") % 3 - 1) * DAY).alias("updatedAt"),
            "messages",
            F.array().cast("array<struct<role: string, content: string>>").alias("history"),
        )
    )
    user = F.col("conv_id") % 40
    name = F.concat(F.when(F.col("conv_id") % 23 == 0, F.lit("c ")).otherwise(F.lit("c")), F.col("conv_id").cast("string"))
    return placed.select(user.alias("user_id"), name.alias("chat_id"), "now_ms", F.col("conv_id").alias("id"), (user % 7 != 3).alias("verified"), body.alias("body"))


def stored_heads(spark, sf):
    """Every other chat is stored already, with a few messages."""
    saves = chat_saves(spark, sf).where(F.col("id") % 2 == 0)
    return saves.select(
        "user_id",
        "chat_id",
        F.lit("old").alias("title"),
        F.lit(0).cast("long").alias("updated_at"),
        F.array().cast("array<struct<role: string, content: string>>").alias("history"),
        F.lit(None).cast("string").alias("summary"),
        (F.lit(2) + F.col("id") % 4).alias("message_count"),
    )


def fold_sql(limits: list[tuple[int, int]]) -> str:
    """One request after another over ``log`` (user_id, id, now_ms, amount, rn), as a recursion."""
    (first, one), (second, two) = limits
    return f"""
    fold AS (
      SELECT user_id, rn, id, now_ms, amount, CAST(0 AS BIGINT) AS b1, CAST(0 AS BIGINT) AS b2, now_ms + {one} AS e1, now_ms + {two} AS e2,
             true AS passed, CAST(NULL AS BIGINT) AS wait FROM log WHERE rn = 1
      UNION ALL
      SELECT user_id, rn, id, now_ms, amount, b1, b2, e1, e2, b1 < {first} AND b2 < {second},
             CASE WHEN b1 >= {first} OR b2 >= {second} THEN CAST(ceil(greatest(CASE WHEN b1 >= {first} THEN e1 - now_ms ELSE 0 END,
               CASE WHEN b2 >= {second} THEN e2 - now_ms ELSE 0 END) / 1000) AS BIGINT) END
      FROM (SELECT l.user_id, l.rn, l.id, l.now_ms, l.amount,
                   CASE WHEN f.e1 <= l.now_ms THEN 0 ELSE f.b1 + CASE WHEN f.passed THEN f.amount ELSE 0 END END AS b1,
                   CASE WHEN f.e2 <= l.now_ms THEN 0 ELSE f.b2 + CASE WHEN f.passed THEN f.amount ELSE 0 END END AS b2,
                   CASE WHEN f.e1 <= l.now_ms THEN l.now_ms + {one} ELSE f.e1 END AS e1,
                   CASE WHEN f.e2 <= l.now_ms THEN l.now_ms + {two} ELSE f.e2 END AS e2
            FROM fold f JOIN log l ON l.user_id = f.user_id AND l.rn = f.rn + 1))"""


@query("save_chats", f"""
    WITH RECURSIVE s AS (SELECT conv_id AS id, conv_id % 40 AS user_id, CASE WHEN conv_id % 23 = 0 THEN 'c ' ELSE 'c' END || conv_id AS chat_id,
        {START} + conv_id * 600000 AS now_ms, count(*) AS n, CASE WHEN conv_id % 2 = 0 THEN 2 + conv_id % 4 ELSE 0 END AS stored,
        CASE WHEN conv_id % 9 = 4 THEN 'invalid title' WHEN bool_or(role NOT IN ('user', 'assistant') OR length(text) > 12000) THEN 'invalid messages'
             WHEN count(*) > 400 THEN 'a chat must not exceed 400 messages' END AS error FROM conversations GROUP BY conv_id),
    log AS (SELECT *, CASE WHEN error IS NULL THEN greatest(0, n - stored) ELSE 0 END AS amount,
                   row_number() OVER (PARTITION BY user_id ORDER BY now_ms, id) AS rn FROM s WHERE user_id % 7 <> 3 AND id % 23 <> 0),
    {fold_sql(SAVE_LIMITS)},
    told AS (SELECT s.*, f.wait, CASE WHEN s.id % 23 = 0 THEN 'not_found' WHEN s.user_id % 7 = 3 THEN 'unverified' WHEN NOT f.passed THEN 'limited'
               WHEN s.error IS NOT NULL THEN 'invalid' ELSE 'saved' END AS status FROM s LEFT JOIN fold f USING (id))
    SELECT user_id, chat_id, id, status, wait, CASE WHEN status = 'invalid' THEN error END AS error,
           CASE WHEN status = 'saved' THEN greatest(0, n - stored) END AS written, CASE WHEN status = 'saved' THEN 'T' || id END AS title,
           CASE WHEN status = 'saved' THEN now_ms + least(id % 3 - 1, 0) * {DAY} END AS updated_at, CASE WHEN status = 'saved' THEN n END AS message_count FROM told""")
def save_chats(spark, sf):
    store = job.chat_store(spark, f"{shared_folder(spark)}/stores/chats-{uuid.uuid4().hex}")
    store.load("heads", stored_heads(spark, sf))
    decided = job.save_chats(store, chat_saves(spark, sf), 0, SAVE_LIMITS)
    saved = F.col("status") == "saved"
    heads = store.read("heads").select("user_id", "chat_id", *[F.col(c).alias(f"_{c}") for c in ("title", "updated_at", "message_count")])
    written = F.when(saved, F.greatest(F.lit(0).cast("long"), F.col("length") - F.col("before")))
    after = [F.when(saved, F.col(f"_{c}")).alias(c) for c in ("title", "updated_at", "message_count")]
    return decided.join(heads, ["user_id", "chat_id"], "left").select("user_id", "chat_id", "id", "status", "wait", "error", written.alias("written"), *after)


def sent_feedback(spark, sf):
    """Bodies of feedback, each sent by one of thirty users about one of five answers."""
    sent = bodies(spark, sf, FEEDBACK)
    user = F.col("conv_id") % 30
    answer = F.concat(F.lit("chat-"), (F.col("turn") % 5).cast("string"), F.when(F.col("turn") % 11 == 6, F.lit("!")).otherwise(F.lit("")))
    number = F.col("conv_id") * 1000 + F.col("turn")
    return sent.select(user.alias("user_id"), answer.alias("feedback_id"), (START + F.col("conv_id") * 600_000 + F.col("turn") * 1_000).alias("now_ms"), number.alias("id"), (user % 7 != 3).alias("verified"), "body")


FEEDBACK_ERRORS = ORACLES["validate_feedback"]


@query("save_feedback", f"""
    WITH RECURSIVE e AS ({FEEDBACK_ERRORS}),
    b AS (SELECT e.*, json_extract_string(CASE WHEN e.error IS NULL THEN CAST(x.body AS JSON) END, '$.question') AS question FROM e
          JOIN ({bodies_sql(FEEDBACK)}) x USING (conv_id, turn)),
    s AS (SELECT conv_id % 30 AS user_id, 'chat-' || turn % 5 || CASE WHEN turn % 11 = 6 THEN '!' ELSE '' END AS feedback_id,
                 {START} + conv_id * 600000 + turn * 1000 AS now_ms, conv_id * 1000 + turn AS id, turn % 11 = 6 AS odd, error, question, comment FROM b),
    log AS (SELECT user_id, id, now_ms, CAST(1 AS BIGINT) AS amount, row_number() OVER (PARTITION BY user_id ORDER BY now_ms, id) AS rn
            FROM s WHERE NOT odd AND user_id % 7 <> 3),
    {fold_sql(RATE_LIMITS)},
    told AS (SELECT s.*, f.wait, CASE WHEN odd THEN 'not_found' WHEN s.user_id % 7 = 3 THEN 'unverified' WHEN NOT f.passed THEN 'limited'
               WHEN s.error IS NOT NULL THEN 'invalid' ELSE 'saved' END AS status FROM s LEFT JOIN fold f USING (id)),
    last AS (SELECT user_id, feedback_id, max(id) AS id FROM told WHERE status = 'saved' GROUP BY ALL)
    SELECT t.user_id, t.feedback_id, t.id, t.status, t.wait, CASE WHEN t.status = 'invalid' THEN t.error END AS error,
           k.question, k.comment, k.now_ms AS updated_at
    FROM told t LEFT JOIN last l ON l.user_id = t.user_id AND l.feedback_id = t.feedback_id LEFT JOIN told k ON k.id = l.id""")
def save_feedback(spark, sf):
    store = job.feedback_store(spark, f"{shared_folder(spark)}/stores/feedback-{uuid.uuid4().hex}")
    decided = job.save_feedback(store, sent_feedback(spark, sf), 0, RATE_LIMITS)
    kept = store.read("feedback").select("user_id", "feedback_id", "question", "comment", "updated_at")
    return decided.join(kept, ["user_id", "feedback_id"], "left").select("user_id", "feedback_id", "id", "status", "wait", "error", "question", "comment", "updated_at")


# The record of a rated answer --------------------------------------------------------------------


@query("feedback_record", """
    WITH m AS (SELECT conv_id AS chat_id, turn, role, text || CASE turn % 3 WHEN 1 THEN ' [1, 3]' WHEN 2 THEN ' [2-4]' ELSE '' END AS text,
                      (conv_id * 7 + turn) % 11 = 0 AS failed FROM v_turns),
    a AS (SELECT x.chat_id, x.turn, x.text AS answer, q.text AS question FROM m x JOIN m q ON q.chat_id = x.chat_id AND q.turn = x.turn - 1 AND q.role = 'user'
          WHERE x.role = 'assistant' AND NOT x.failed AND x.text <> ''),
    rated AS (SELECT *, CASE (chat_id + turn) % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' END AS rating FROM a),
    s AS (SELECT chat_id, turn, n, 'book/' || n || '/' || (CASE WHEN turn % 3 = 1 AND n IN (1, 3) OR turn % 3 = 2 AND n BETWEEN 2 AND 4 THEN 'true' ELSE 'false' END)
            || '/' || CASE (chat_id + n) % 4 WHEN 0 THEN 'up' WHEN 1 THEN 'down' ELSE '-' END AS x
          FROM rated, unnest(range(1, CAST(1 + (chat_id + turn) % 4 AS BIGINT))) AS r(n))
    SELECT r.chat_id, r.turn, r.question, r.answer, r.rating, coalesce(string_agg(s.x, ',' ORDER BY s.n), '') AS sources,
           CASE WHEN r.rating = 'down' THEN 'unclear' ELSE '' END AS reasons, CASE WHEN r.chat_id % 2 = 0 THEN 'comment ' || r.turn END AS comment
    FROM rated r LEFT JOIN s ON s.chat_id = r.chat_id AND s.turn = r.turn GROUP BY r.chat_id, r.turn, r.question, r.answer, r.rating""")
def feedback_record(spark, sf):
    labels = F.when(F.col("turn") % 3 == 1, F.lit(" [1, 3]")).when(F.col("turn") % 3 == 2, F.lit(" [2-4]")).otherwise(F.lit(""))
    failed = (F.col("conv_id") * 7 + F.col("turn")) % 11 == 0
    messages = v.turns(spark, sf).select(
        F.col("conv_id").alias("chat_id"), "turn", "role", F.concat("text", labels).alias("text"), F.when(failed, F.lit("error")).alias("status")
    )
    answers, keys = ch.rateable_answers(messages), ["chat_id", "turn"]
    count = (F.col("chat_id") + F.col("turn")) % 4
    numbers = F.when(count > 0, F.sequence(F.lit(1).cast("long"), count)).otherwise(F.array().cast("array<bigint>"))
    sources = answers.select(*keys, F.explode(numbers).alias("number")).withColumn("id", F.concat(F.lit("book/"), F.col("number").cast("string")))

    def rating(code):
        return F.when(code == 0, F.lit("up")).when(code == 1, F.lit("down"))

    given = rating((F.col("chat_id") + F.col("turn")) % 3)
    reasons = F.when(given == "down", F.array(F.lit("unclear")))
    comment = F.when(F.col("chat_id") % 2 == 0, F.concat(F.lit("comment "), F.col("turn").cast("string")))
    main = answers.select(*keys, given.alias("rating"), reasons.alias("reasons"), comment.alias("comment"))
    rated = sources.select(*keys, "number", rating((F.col("chat_id") + F.col("number")) % 4).alias("rating")).where("rating IS NOT NULL")
    found = rt.feedback_records(answers, sources, main, rated, keys)
    source = F.transform("sources", lambda s: F.concat_ws("/", s["id"], s["cited"].cast("string"), F.coalesce(s["rating"], F.lit("-"))))
    return found.select(*keys, "question", "answer", "rating", F.array_join(source, ",").alias("sources"), F.array_join("reasons", ",").alias("reasons"), "comment")


# Whole chats ---------------------------------------------------------------------------------------


@query("open_chat_whole", f"""
    WITH h AS (SELECT conv_id, conv_id % 40 AS user_id, 'c' || conv_id AS chat_id FROM conversations WHERE conv_id % 3 <> 1 GROUP BY conv_id)
    SELECT h.user_id, h.chat_id, 'message' AS part, t.turn AS place, t.role, t.text FROM conversations t JOIN h USING (conv_id)
    UNION ALL SELECT h.user_id, h.chat_id, 'history', t.turn, t.role, t.text FROM conversations t JOIN h USING (conv_id) WHERE t.turn < 2
    UNION ALL SELECT user_id, chat_id, 'summary', CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), 'so far ' || conv_id FROM h WHERE conv_id % 2 = 0""")
def open_chat_whole(spark, sf):
    keyed = v.turns(spark, sf).select((F.col("conv_id") % 40).alias("user_id"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("chat_id"), "conv_id", "turn", "role", "text")
    early = F.when(F.col("turn") < 2, F.struct("turn", "role", F.col("text").alias("content")))
    heads = keyed.where("conv_id % 3 <> 1").groupBy("user_id", "chat_id", "conv_id").agg(F.array_sort(F.collect_list(early)).alias("h"))
    history = F.transform("h", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("history")
    summary = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("so far "), F.col("conv_id").cast("string"))).alias("summary")
    return ch.open_conversations(heads.select("user_id", "chat_id", history, summary), keyed.drop("conv_id"))


@query("read_archive_whole", f"""
    WITH b AS ({bodies_sql(CHATS)}),
    e AS (SELECT conv_id * 1000 + turn AS archive_id, CAST(body AS JSON) AS v FROM b),
    shaped AS (SELECT * FROM e WHERE json_type(v, '$.title') = 'VARCHAR' AND json_type(v, '$.updatedAt') IN ('BIGINT', 'UBIGINT', 'DOUBLE')
      AND json_type(v, '$.messages') = 'ARRAY' AND json_type(v, '$.history') = 'ARRAY')
    SELECT archive_id, CAST(1 AS BIGINT) AS place, 'x' || archive_id AS chat_id, json_extract_string(v, '$.title') AS title,
           CAST(floor(CAST(json_extract(v, '$.updatedAt') AS DOUBLE)) AS BIGINT) AS updated_at,
           coalesce(array_to_string({listed("messages", MESSAGE_SQL)}, '|'), '') AS messages, {HISTORY_SQL.replace("regexp_replace(json_extract_string(t, '$.content'), '^\\s+|\\s+$', '', 'g')", "json_extract_string(t, '$.content')")},
           CASE WHEN json_type(v, '$.summary') = 'VARCHAR' THEN json_extract_string(v, '$.summary') ELSE CAST(json_extract(v, '$.summary') AS VARCHAR) END AS summary FROM shaped""")
def read_archive_whole(spark, sf):
    rows = bodies(spark, sf, CHATS).withColumn("archive_id", F.col("conv_id") * 1000 + F.col("turn"))
    # Each body becomes the only chat of an archive, with an id of its own.
    named = F.concat(F.lit('[{"id":"x'), F.col("archive_id").cast("string"), F.lit('",'), F.substring("body", F.lit(2), F.length("body")), F.lit("]"))
    found = ch.whole_archives(rows.select("archive_id", named.alias("archive")))
    return found.select("archive_id", "place", "chat_id", "title", "updated_at", messages_text(), history(), "summary")
