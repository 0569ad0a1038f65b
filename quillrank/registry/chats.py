"""Queries of saved chats, libraries and feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrank.operators import chats as ch
from quillrank.operators import ratings as rt
from quillrank.registry import query
from quillrank.sources import views as v
from quillrank.streaming import ratings as stream_ratings
from quillrank.streaming.runs import replay

NOW_MS = 1_706_626_800_000  # 2024-01-30 15:00 UTC, within the event log


def chats(spark, sf):
    """Events as chats of their user."""
    return v.events(spark, sf).select(
        "user_id",
        F.col("event_id").alias("chat_id"),
        F.concat(F.initcap("event_type"), F.lit(" chat "), F.col("event_id").cast("string")).alias("title"),
        F.col("now_ms").alias("updated_at"),
        (F.floor("value") * 10 + 5).alias("bytes"),
    )


def messages(spark, sf):
    """Turns as messages; some failed."""
    failed = (F.col("conv_id") * 7 + F.col("turn")) % 11 == 0
    return v.turns(spark, sf).select(
        F.col("conv_id").alias("chat_id"), "turn", "role", "text", F.when(failed, F.lit("error")).alias("status")
    )


def stored(spark, sf):
    """The stored heads of chats: how many messages each has."""
    return v.turns(spark, sf).select(F.col("conv_id").alias("chat_id")).distinct().withColumn(
        "message_count", F.lit(2) + F.col("chat_id") % 4
    )


@query("list_chats", """
    SELECT user_id, chat_id, title, updated_at FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, chat_id) AS n FROM v_chats) WHERE n <= 20""")
def list_chats(spark, sf):
    return ch.list_chats(chats(spark, sf), cap=20).drop("place")


@query("open_chat", """
    SELECT conv_id AS chat_id, turn, role, text, CASE WHEN turn < 1000 THEN lpad(CAST(turn AS VARCHAR), 4, '0') ELSE CAST(turn AS VARCHAR) END AS message_doc
    FROM v_turns WHERE conv_id IN (SELECT chat_id FROM v_chats)""")
def open_chat(spark, sf):
    return ch.open_chats(chats(spark, sf), messages(spark, sf).drop("status"))


@query("save_chat_delta", """
    WITH n AS (SELECT conv_id, count(*) AS n FROM v_turns GROUP BY ALL)
    SELECT t.conv_id AS chat_id, t.turn, 'set' AS action FROM v_turns t WHERE t.turn >= 2 + t.conv_id % 4
    UNION ALL
    SELECT n.conv_id, CAST(s.turn AS BIGINT), 'delete' FROM n, unnest(range(0, 6)) AS s(turn)
    WHERE s.turn < 2 + n.conv_id % 4 AND s.turn >= n.n""")
def save_chat_delta(spark, sf):
    heads = stored(spark, sf)
    places = heads.select("chat_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("message_count") - 1)).alias("turn"))
    return ch.save_delta(heads, places, messages(spark, sf))


@query("new_messages", """
    SELECT conv_id AS chat_id, greatest(0, count(*) - (2 + conv_id % 4)) AS written FROM v_turns GROUP BY conv_id""")
def new_messages(spark, sf):
    return ch.new_messages(stored(spark, sf), messages(spark, sf))


@query("delete_cascade", """
    WITH gone AS (SELECT DISTINCT user_id FROM events WHERE user_id % 10 = 3)
    SELECT 'chats' AS source, user_id, chat_id AS key FROM v_chats WHERE user_id NOT IN (SELECT user_id FROM gone)
    UNION ALL SELECT 'messages', conv_id, turn FROM v_turns WHERE conv_id NOT IN (SELECT user_id FROM gone)
    UNION ALL SELECT 'feedback', user_id, event_id FROM v_feedback WHERE user_id NOT IN (SELECT user_id FROM gone)""")
def delete_cascade(spark, sf):
    gone = v.events(spark, sf).filter(F.col("user_id") % 10 == 3).select("user_id").distinct()
    tables = {
        "chats": chats(spark, sf).select("user_id", F.col("chat_id").alias("key")),
        "messages": v.turns(spark, sf).select(F.col("conv_id").alias("user_id"), F.col("turn").alias("key")),
        "feedback": feedback(spark, sf).select("user_id", F.col("event_id").alias("key")),
    }
    parts = [ch.without_deleted(frame, gone).withColumn("source", F.lit(name)) for name, frame in tables.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("read_archive", r"""
    WITH parsed AS (SELECT event_id, CASE WHEN json_valid(archive) THEN CAST(archive AS JSON) END AS a FROM v_archives),
    entries AS (SELECT event_id, generate_subscripts(e, 1) AS p, unnest(e) AS e FROM (
      SELECT event_id, CASE WHEN json_type(a) = 'ARRAY' THEN CAST(a AS JSON[]) END AS e FROM parsed)),
    shaped AS (SELECT event_id, p, json_extract_string(e, '$.id') AS chat_id, json_extract_string(e, '$.title') AS title,
                      CAST(json_extract(e, '$.updatedAt') AS BIGINT) AS updated_at
      FROM entries WHERE json_type(e, '$.id') = 'VARCHAR' AND json_type(e, '$.title') = 'VARCHAR'
        AND json_type(e, '$.updatedAt') IN ('BIGINT', 'UBIGINT', 'DOUBLE') AND json_type(e, '$.messages') = 'ARRAY' AND json_type(e, '$.history') = 'ARRAY')
    SELECT event_id AS archive_id, chat_id, title, updated_at, row_number() OVER (PARTITION BY event_id ORDER BY updated_at DESC, p) AS place FROM shaped""")
def read_archive(spark, sf):
    return ch.read_archives(archives(spark, sf))


def archives(spark, sf):
    """One archive per event: two chats and a broken one, or no array, or no JSON at all."""
    head = F.format_string(
        '{"id":"c%d","title":"%s","updatedAt":%d,"messages":[],"history":[]}', "event_id", "event_type", "now_ms"
    )
    older = F.format_string('{"id":"d%d","title":"older","updatedAt":%d,"messages":[1],"history":[]}', "event_id", F.col("now_ms") - 1000)
    broken = (
        F.when(F.col("event_id") % 3 == 0, F.lit('{"id": 1}'))
        .when(F.col("event_id") % 3 == 1, F.lit('{"id":"x","title":"x","updatedAt":"1","messages":[],"history":[]}'))
        .otherwise(F.lit('{"id":"x","title":"x","updatedAt":1,"messages":{},"history":[]}'))
    )
    whole = (
        F.when(F.col("event_id") % 10 == 7, F.lit("{nope"))
        .when(F.col("event_id") % 10 == 8, head)
        .otherwise(F.concat(F.lit("["), older, F.lit(","), broken, F.lit(","), head, F.lit("]")))
    )
    return v.events(spark, sf).select(F.col("event_id").alias("archive_id"), whole.alias("archive"))


@query("retain_newest", """
    WITH first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY chat_id % 1000 = user_id DESC, updated_at DESC, chat_id) AS place FROM v_chats) WHERE place <= 50),
    run AS (SELECT *, sum(bytes) OVER (PARTITION BY user_id ORDER BY place) AS used FROM first)
    SELECT user_id, chat_id, place, place = 1 AND used > 900 AS too_large FROM run WHERE used <= 900 OR place = 1""")
def retain_newest(spark, sf):
    kept = ch.retain_newest(chats(spark, sf), quota=900, saved=F.col("chat_id") % 1000 == F.col("user_id"))
    return kept.select("user_id", "chat_id", F.col("place").cast("long").alias("place"), "too_large")


@query("merge_library", """
    WITH local AS (SELECT user_id, chat_id % 50 AS chat_id, title || ' local' AS title, updated_at, chat_id % 9 <> 0 AS valid, chat_id AS o
                   FROM v_chats WHERE chat_id % 3 = 0),
    local_last AS (SELECT * EXCLUDE (o) FROM local QUALIFY row_number() OVER (PARTITION BY user_id, chat_id ORDER BY o DESC) = 1),
    account AS (SELECT user_id, chat_id % 50 AS chat_id, title, updated_at, chat_id AS o FROM v_chats WHERE chat_id % 3 <> 0),
    account_last AS (SELECT * EXCLUDE (o) FROM account QUALIFY row_number() OVER (PARTITION BY user_id, chat_id ORDER BY o DESC) = 1)
    SELECT user_id, chat_id, title, updated_at, 'account' AS library, false AS failed FROM local_last WHERE valid
    UNION ALL SELECT a.user_id, a.chat_id, a.title, a.updated_at, 'account', false FROM account_last a
      WHERE NOT EXISTS (SELECT 1 FROM local_last l WHERE l.valid AND l.user_id = a.user_id AND l.chat_id = a.chat_id)
    UNION ALL SELECT user_id, chat_id, title, updated_at, 'local', true FROM local_last WHERE NOT valid""")
def merge_library(spark, sf):
    found = chats(spark, sf).select(
        "user_id", (F.col("chat_id") % 50).alias("chat_id"), "title", "updated_at", F.col("chat_id").alias("o")
    )
    last = lambda frame: rt.latest(frame, ["user_id", "chat_id"], "o")
    local = last(found.filter(F.col("o") % 3 == 0)).select(
        "user_id", "chat_id", F.concat("title", F.lit(" local")).alias("title"), "updated_at", (F.col("o") % 9 != 0).alias("valid")
    )
    return ch.merge_library(last(found.filter(F.col("o") % 3 != 0)).drop("o"), local)


@query("valid_id", """
    SELECT page_id, regexp_full_match(id, '[A-Za-z0-9_-]{1,64}') AS valid FROM (SELECT page_id, replace(replace(url, 'http://', ''), '/', '-') AS id FROM pages)""")
def valid_id(spark, sf):
    name = F.replace(F.replace("url", F.lit("http://"), F.lit("")), F.lit("/"), F.lit("-"))
    return v.table(spark, sf, "pages").select("page_id", ch.valid_id(name).alias("valid"))


@query("clamp_updated_at", f"SELECT chat_id, least(updated_at + chat_id * 1000, {NOW_MS}) AS updated_at FROM v_chats")
def clamp_updated_at(spark, sf):
    claimed = F.col("updated_at") + F.col("chat_id") * 1000
    return chats(spark, sf).select("chat_id", ch.clamp_updated_at(claimed, F.lit(NOW_MS)).alias("updated_at"))


@query("title_search", "SELECT chat_id, title FROM v_chats WHERE contains(lower(title), lower(trim('  CHAT 1 ')))")
def title_search(spark, sf):
    return chats(spark, sf).filter(ch.title_matches(F.col("title"), F.lit("  CHAT 1 "))).select("chat_id", "title")


@query("verified_only", """
    SELECT user_id, chat_id FROM v_chats WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def verified_only(spark, sf):
    users = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 0).alias("verified"))
    return ch.verified_only(chats(spark, sf).select("user_id", "chat_id"), users)


@query("saved_messages", """
    SELECT chat_id, turn, role, text FROM (SELECT *, lead(status) OVER (PARTITION BY chat_id ORDER BY turn) AS next FROM v_messages)
    WHERE status IS DISTINCT FROM 'error' AND next IS DISTINCT FROM 'error'""")
def saved_messages(spark, sf):
    return ch.saved_messages(messages(spark, sf)).select("chat_id", "turn", "role", "text")


@query("rateable_answers", """
    SELECT chat_id, turn, text AS answer, question FROM (
      SELECT *, lag(role) OVER w AS asked, lag(text) OVER w AS question FROM v_messages WINDOW w AS (PARTITION BY chat_id ORDER BY turn))
    WHERE role = 'assistant' AND status IS NULL AND text <> '' AND asked = 'user'""")
def rateable_answers(spark, sf):
    return ch.rateable_answers(messages(spark, sf))


@query("chat_age_groups", f"""
    WITH listed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, chat_id) AS place FROM v_chats),
    aged AS (SELECT *, CASE WHEN updated_at >= m THEN 'Today' WHEN updated_at >= m - 86400000 THEN 'Yesterday'
               WHEN updated_at >= m - 604800000 THEN 'Previous 7 days' ELSE 'Older' END AS label
             FROM (SELECT *, {NOW_MS} - {NOW_MS} % 86400000 AS m FROM listed WHERE place <= 200))
    SELECT user_id, chat_id, label, CAST(sum(CASE WHEN label IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY place) AS BIGINT) AS run
    FROM (SELECT *, lag(label) OVER (PARTITION BY user_id ORDER BY place) AS before FROM aged)""")
def chat_age_groups(spark, sf):
    groups = ch.age_groups(ch.list_chats(chats(spark, sf)), NOW_MS)
    return groups.select("user_id", "chat_id", "label", "run")


@query("day_bounds", """
    SELECT event_id, now_ms - now_ms % 86400000 AS today, now_ms - now_ms % 86400000 - 604800000 AS week FROM v_events""")
def day_bounds(spark, sf):
    today = ch.midnight_of(F.col("now_ms"))
    return v.events(spark, sf).select("event_id", today.alias("today"), (today - 7 * ch.DAY_MS).alias("week"))


@query("chat_title", r"""
    WITH f AS (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS text FROM v_turns GROUP BY ALL),
    l AS (SELECT conv_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS line FROM f)
    SELECT conv_id AS chat_id, coalesce(CASE WHEN length(line) > 80 THEN rtrim(left(line, 79)) || '…' ELSE line END, '') AS title FROM l""")
def chat_title(spark, sf):
    return ch.chat_titles(messages(spark, sf))


# Feedback --------------------------------------------------------------------------------------


def feedback(spark, sf):
    """Events as feedback: the rating by the event's type, the answer by its number."""
    rating = F.when(F.col("event_type") == "purchase", F.lit("up")).when(F.col("event_type") == "error", F.lit("down"))
    infix = F.when(F.col("event_id") % 3 == 0, F.lit("-x")).otherwise(F.lit(""))
    suffix = F.when(F.col("event_id") % 7 == 0, F.lit("a")).otherwise(F.lit(""))
    answer = F.col("event_id") % 20
    return v.events(spark, sf).select(
        "user_id",
        "event_id",
        answer.alias("answer_id"),
        F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string"), infix, F.lit("-"), answer.cast("string"), suffix).alias("feedback_id"),
        rating.alias("rating"),
        F.when(F.col("event_type") == "error", F.array(F.lit("unclear"))).alias("reasons"),
        F.when(F.col("event_type") == "view", F.col("event_type")).alias("comment"),
    )


@query("put_feedback", """
    SELECT user_id, answer_id, max(event_id) AS event_id, arg_max({'r': rating}, event_id).r AS rating FROM v_feedback GROUP BY ALL""")
def put_feedback(spark, sf):
    rows = feedback(spark, sf).select("user_id", "answer_id", "event_id", "rating")
    return rt.latest(rows, ["user_id", "answer_id"], "event_id")


@query("list_feedback", r"""
    SELECT event_id, regexp_extract(feedback_id, '^(.*)-(\d+)$', 1) AS chat_id, CAST(regexp_extract(feedback_id, '^(.*)-(\d+)$', 2) AS BIGINT) AS message_id,
           rating, array_to_string(coalesce(reasons, []), ',') AS reasons, comment
    FROM v_feedback WHERE regexp_matches(feedback_id, '-\d+$')""")
def list_feedback(spark, sf):
    listed = rt.with_defaults(rt.split_feedback_id(feedback(spark, sf)))
    return listed.select(
        "event_id", "chat_id", "message_id", "rating", F.array_join("reasons", ",").alias("reasons"), "comment"
    )


@query("answer_ratings", """
    SELECT event_id, coalesce(string_agg(i || '=' || x, ',' ORDER BY i), '') AS sources, count(x) AS rated FROM (
      SELECT event_id, i, CASE (event_id + i * i) % 4 WHEN 0 THEN 'up' WHEN 1 THEN 'down' END AS x FROM v_events, unnest(range(1, 6)) AS u(i))
    GROUP BY event_id""")
def answer_ratings(spark, sf):
    def rating(i: int):
        code = (F.col("event_id") + i * i) % 4
        return F.when(code == 0, F.lit("up")).when(code == 1, F.lit("down"))

    rated = rt.rated_sources(F.array(*[rating(i) for i in range(1, 6)]))
    entries = F.transform(F.map_entries("m"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"]))
    return v.events(spark, sf).select("event_id", rated.alias("m")).select(
        "event_id", F.array_join(entries, ",").alias("sources"), F.size("m").cast("long").alias("rated")
    )


def rating_events(spark, sf):
    """Events as rating events of (user, answer)."""
    kind = (
        F.when(F.col("event_type").isin("purchase", "error", "signup"), F.when(F.col("event_id") % 3 == 0, F.lit("source")).otherwise(F.lit("answer")))
        .when(F.col("event_type") == "view", F.lit("reasons"))
        .otherwise(F.lit("comment"))
    )
    rating = F.when(F.col("event_type") == "purchase", F.lit("up")).when(F.col("event_type") == "error", F.lit("down"))
    return v.events(spark, sf).select(
        "user_id",
        (F.col("event_id") % 20).alias("answer_id"),
        F.col("event_id").alias("seq"),
        kind.alias("kind"),
        rating.alias("rating"),
        (F.col("event_id") % 4).alias("number"),
        F.concat(F.lit("unclear,"), F.col("event_id").cast("string")).alias("reasons"),
        F.concat(F.lit("comment "), F.col("event_id").cast("string")).alias("comment"),
    )


FOLDED = """
    SELECT user_id, answer_id, arg_max({'r': rating}, seq) FILTER (WHERE kind = 'answer').r AS rating,
           CASE WHEN coalesce(max(seq) FILTER (WHERE kind = 'reasons') > max(seq) FILTER (WHERE kind = 'answer' AND rating IS DISTINCT FROM 'down'), true)
                THEN arg_max(reasons, seq) FILTER (WHERE kind = 'reasons') END AS reasons,
           arg_max(comment, seq) FILTER (WHERE kind = 'comment') AS comment
    FROM v_rating_events GROUP BY user_id, answer_id"""


@query("rating_fold", FOLDED)
def rating_fold(spark, sf):
    return rt.fold_ratings(rating_events(spark, sf), ["user_id", "answer_id"])


@query("source_rating_fold", """
    SELECT user_id, answer_id, number, rating FROM (SELECT *, row_number() OVER (PARTITION BY user_id, answer_id, number ORDER BY seq DESC) AS n
      FROM v_rating_events WHERE kind = 'source') WHERE n = 1 AND rating IS NOT NULL""")
def source_rating_fold(spark, sf):
    return rt.fold_source_ratings(rating_events(spark, sf), ["user_id", "answer_id"])


@query("rating_fold_stream", FOLDED)
def rating_fold_streamed(spark, sf):
    """The last state that the stream gave of each answer, over several micro-batches.

    The stream says nothing of an answer whose events left it as it was; such answers have no ratings.
    """
    events, keys = rating_events(spark, sf), ["user_id", "answer_id"]
    changes = replay(events, "seq", stream_ratings.fold_ratings, "ratings")
    last = rt.latest(changes, keys, "seq").select(*keys, "rating", "reasons", "comment")
    return events.select(*keys).distinct().join(last, keys, "left")
