"""Queries of reply parsing, citations, prompts and histories."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillrank.functions import citing, network, paths, prompts, words
from quillrank.functions import fixed_values as fixed
from quillrank.operators import fusion
from quillrank.operators import history as hist
from quillrank.operators import ratings as rt
from quillrank.operators import replies as rep
from quillrank.operators import validate as val
from quillrank.registry import query
from quillrank.sources import requests as r
from quillrank.sources import views as v
from quillrank.sources.shared import shared_folder


@query("reply_lines", """
    SELECT reply_id, count(*) AS lines, string_agg(line, '|' ORDER BY line_no) AS text FROM v_lines GROUP BY reply_id""")
def reply_lines(spark, sf):
    found = r.replies(spark, sf).select("reply_id", words.reply_lines(F.col("reply")).alias("l"))
    return found.filter(F.size("l") > 0).select(
        "reply_id", F.size("l").cast("long").alias("lines"), F.array_join("l", "|").alias("text")
    )


@query("parse_symptoms", "SELECT reply_id, ord, item FROM v_parsed_symptoms")
def parse_symptoms(spark, sf):
    return rep.parse_symptoms(r.replies(spark, sf), "reply_id")


@query("parse_diseases", "SELECT reply_id, ord, item FROM v_parsed_diseases")
def parse_diseases(spark, sf):
    return rep.parse_diseases(r.replies(spark, sf), "reply_id")


@query("distinct_keep_first", """
    WITH f AS (SELECT source, lower(lang) AS l, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY source, lower(lang))
    SELECT source, doc_id, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ord FROM f""")
def distinct_keep_first(spark, sf):
    items = v.table(spark, sf, "documents").select("source", "doc_id", "lang")
    return rep.distinct_keep_first(items, "source", "doc_id", "lang", 15)


@query("parse_kind", r"""
    SELECT reply_id, CASE WHEN regexp_matches(reply, '(?i)^\W*question\b') THEN 'question' ELSE 'case' END AS kind FROM v_kind_replies""")
def parse_kind(spark, sf):
    return r.kind_replies(spark, sf).select("reply_id", words.parse_kind(F.col("reply")).alias("kind"))


@query("model_replies", "SELECT conv_id * 1000 + turn AS reply_id, text AS reply, CAST(NULL AS VARCHAR) AS error FROM conversations")
def model_replies(spark, sf):
    """A stand-in model that repeats the case, in place of a caller's."""

    def repeat(asked: list[str]) -> list[str]:
        return [text.removeprefix("<case>\n").removesuffix("\n</case>") for text in asked]

    turns = v.turns(spark, sf).withColumn("reply_id", F.col("conv_id") * 1000 + F.col("turn"))
    return rep.model_replies(turns, "reply_id", repeat)


@query("model_replies_resumed", """
    SELECT conv_id * 1000 + turn AS reply_id, CASE WHEN length(text) % 5 <> 0 THEN text END AS reply,
           CASE WHEN length(text) % 5 = 0 THEN 'ValueError: no reply' END AS error, CAST(CASE WHEN length(text) % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) AS attempt
    FROM conversations""")
def model_replies_resumed(spark, sf):
    """A second run asks again only what failed in the first."""

    def repeat(asked: list[str]) -> list[str]:
        texts = [text.removeprefix("<case>\n").removesuffix("\n</case>") for text in asked]
        if any(len(text) % 5 == 0 for text in texts):
            raise ValueError("no reply")
        return texts

    turns = v.turns(spark, sf).withColumn("reply_id", F.col("conv_id") * 1000 + F.col("turn"))
    store = rep.ReplyStore(spark, f"{shared_folder(spark)}/stores/replies-{uuid.uuid4().hex}", attempts=2)
    store.ask(turns, "reply_id", repeat)
    return store.ask(turns, "reply_id", repeat)


# Citations -------------------------------------------------------------------------------------

LABELS = r"""
    WITH raw AS (SELECT answer_id, answer, sources, regexp_extract_all(answer, '\[\d+(?:\s*[,–-]\s*\d+)*\]\(?') AS tokens FROM v_answers),
    token AS (SELECT answer_id, generate_subscripts(tokens, 1) AS t, unnest(tokens) AS token FROM raw),
    label AS (SELECT * FROM token WHERE token NOT LIKE '%('),
    part AS (SELECT answer_id, t, generate_subscripts(string_split(token[2:-2], ','), 1) AS p, unnest(string_split(token[2:-2], ',')) AS part FROM label),
    ends AS (SELECT answer_id, t, p, TRY_CAST(trim(string_split(replace(part, '–', '-'), '-')[1]) AS BIGINT) AS a,
                    TRY_CAST(trim(string_split(replace(part, '–', '-'), '-')[2]) AS BIGINT) AS b FROM part),
    number AS (SELECT answer_id, t, p, unnest(CASE WHEN b IS NOT NULL AND b >= a AND b - a <= 20 THEN range(a, b + 1) ELSE [a] END) AS n FROM ends)"""


@query("cited_numbers", LABELS + """, firsts AS (SELECT answer_id, n, min(t * 100000 + p * 1000 + n) AS place FROM number GROUP BY ALL)
    SELECT answer_id, string_agg(CAST(n AS VARCHAR), ',' ORDER BY place) AS cited FROM firsts GROUP BY answer_id""")
def cited_numbers(spark, sf):
    found = r.answers(spark, sf).select("answer_id", citing.cited_numbers(F.col("answer")).alias("c"))
    return found.filter(F.size("c") > 0).select("answer_id", F.array_join("c", ",").alias("cited"))


@query("listed_sources", LABELS + """
    SELECT a.answer_id, coalesce(string_agg(CAST(s.n AS VARCHAR), ',' ORDER BY s.n), '') AS listed
    FROM v_answers a LEFT JOIN (SELECT answer_id, sources, unnest(range(1, sources + 1)) AS n FROM v_answers) s
      ON s.answer_id = a.answer_id AND (s.n IN (SELECT n FROM number WHERE number.answer_id = s.answer_id)
         OR s.answer_id NOT IN (SELECT answer_id FROM number))
    GROUP BY a.answer_id""")
def listed_sources(spark, sf):
    listed = citing.listed_sources(F.col("answer"), F.col("sources"))
    return r.answers(spark, sf).select("answer_id", F.array_join(listed, ",").alias("listed"))


@query("link_citations", LABELS + r""",
    links AS (SELECT answer_id, t, string_agg('[' || n || '](#source-' || n || ')', '' ORDER BY p, n) AS link
              FROM number JOIN raw USING (answer_id) WHERE n BETWEEN 1 AND sources GROUP BY ALL),
    pieces AS (SELECT answer_id, generate_subscripts(x, 1) AS t, unnest(x) AS text FROM (
      SELECT answer_id, regexp_split_to_array(answer, '\[\d+(?:\s*[,–-]\s*\d+)*\]\(?') AS x FROM raw))
    SELECT p.answer_id, string_agg(p.text || coalesce(l.link, k.token, ''), '' ORDER BY p.t) AS linked
    FROM pieces p LEFT JOIN links l ON l.answer_id = p.answer_id AND l.t = p.t
    LEFT JOIN token k ON k.answer_id = p.answer_id AND k.t = p.t GROUP BY p.answer_id""")
def link_citations(spark, sf):
    linked = citing.link_citations(F.col("answer"), F.col("sources"))
    return r.answers(spark, sf).select("answer_id", linked.alias("linked"))


@query("cited_flags", LABELS + """
    SELECT a.answer_id, s.n AS number, EXISTS (SELECT 1 FROM number x WHERE x.answer_id = a.answer_id AND x.n = s.n) AS cited
    FROM v_answers a JOIN (SELECT answer_id, unnest(range(1, sources + 1)) AS n FROM v_answers) s USING (answer_id)""")
def cited_flags(spark, sf):
    answers = r.answers(spark, sf).filter(F.col("sources") >= 1)
    each = answers.select("answer_id", F.explode(F.sequence(F.lit(1).cast("long"), "sources")).alias("number"))
    return rt.cited_flags(answers, each, ["answer_id"]).select("answer_id", "number", "cited")


# Short texts -----------------------------------------------------------------------------------


@query("title_from", r"""
    WITH l AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS line FROM v_turns)
    SELECT conv_id, turn, CASE WHEN length(line) > 80 THEN rtrim(left(line, 79)) || '…' ELSE line END AS title FROM l""")
def title_from(spark, sf):
    return v.turns(spark, sf).select("conv_id", "turn", prompts.title_from(F.col("text")).alias("title"))


@query("truncate_ellipsis", r"""
    WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM documents)
    SELECT doc_id, CASE WHEN length(text) > 12000 THEN regexp_replace(left(text, 12000), '\s+$', '') || '…' ELSE text END AS answer,
           CASE WHEN length(text) > 4000 THEN regexp_replace(left(text, 3999), '\s+$', '') || '…' ELSE text END AS summary FROM t""")
def truncate_ellipsis(spark, sf):
    return v.table(spark, sf, "documents").select(
        "doc_id",
        prompts.bounded_answer(F.col("text")).alias("answer"),
        prompts.bounded_summary(F.col("text")).alias("summary"),
    )


@query("client_address", """
    SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'direct' WHEN event_id % 4 = 1 THEN '10.0.0.' || user_id
      WHEN event_id % 4 = 2 THEN '192.168.1.' || user_id ELSE 'direct' END AS address FROM events""")
def client_address(spark, sf):
    return r.forwarded(spark, sf).select("event_id", network.client_address(F.col("forwarded")).alias("address"))


@query("client_key", """
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN '203.0.113.' || u WHEN 1 THEN '2001:db8:0:' || lower(to_hex(u)) || '::/64'
      WHEN 2 THEN '203.0.113.' || u WHEN 3 THEN 'fe80::1%eth' || u ELSE '0:0:0:0::/64' END AS client FROM (SELECT *, user_id % 256 AS u FROM events)""")
def client_key(spark, sf):
    return r.addresses(spark, sf).select("event_id", network.client_key(F.col("address")).alias("client"))


@query("feedback_id", """
    SELECT DISTINCT conv_id, turn, 'chat-' || conv_id || '-' || turn AS feedback_id, 'chat-' || conv_id AS chat_id, turn AS message_id FROM v_turns""")
def feedback_id(spark, sf):
    from quillrank.operators.ratings import split_feedback_id

    chat = F.concat(F.lit("chat-"), F.col("conv_id").cast("string"))
    ids = v.turns(spark, sf).select("conv_id", "turn", F.concat_ws("-", chat, F.col("turn").cast("string")).alias("feedback_id"))
    return split_feedback_id(ids)


@query("message_doc_id", """
    SELECT DISTINCT event_id, CASE WHEN length(CAST(event_id AS VARCHAR)) >= 4 THEN CAST(event_id AS VARCHAR)
      ELSE lpad(CAST(event_id AS VARCHAR), 4, '0') END AS message FROM events""")
def message_doc_id(spark, sf):
    return v.events(spark, sf).select("event_id", paths.pad_index(F.col("event_id")).alias("message"))


@query("scoring_math", """
    SELECT l_orderkey, l_linenumber, l_partkey, round(1.0::DOUBLE / (60 + l_linenumber), 9) AS rank_share,
           round(1.0::DOUBLE / ln(l_quantity + 2), 9) AS rarity, greatest(0, 25 - CAST(l_quantity AS BIGINT)) AS room,
           CAST(ceil(l_extendedprice / 1000) AS BIGINT) AS seconds, CAST(floor(l_extendedprice / 4) AS BIGINT) AS quarter FROM lineitem""")
def scoring_math(spark, sf):
    return v.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.round(fusion.rank_share(F.col("l_linenumber")), 9).alias("rank_share"),
        F.round(F.lit(1.0) / F.log(F.col("l_quantity") + 2), 9).alias("rarity"),
        F.greatest(F.lit(0).cast("long"), F.lit(25) - F.col("l_quantity").cast("long")).alias("room"),
        F.ceil(F.col("l_extendedprice") / 1000).alias("seconds"),
        F.floor(F.col("l_extendedprice") / 4).alias("quarter"),
    )


@query("json_shape", """
    SELECT event_id, json_type(props) = 'OBJECT' AS is_record, json_type(props, '$.k') IN ('BIGINT', 'UBIGINT') AS is_integer,
           CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_shape(spark, sf):
    parsed = v.table(spark, sf, "events").select("event_id", F.try_parse_json("props").alias("p"))
    k = val.field(F.col("p"), "k")
    is_integer = val.is_kind(k, "BIGINT")
    return parsed.select("event_id", val.is_kind(F.col("p"), "OBJECT").alias("is_record"), is_integer.alias("is_integer"), F.try_variant_get(k, "$", "bigint").alias("k"))


# Histories and prompts -------------------------------------------------------------------------

CONVERSATION = """
    WITH lines AS (SELECT conv_id, string_agg('<' || role || '>' || text || '</' || role || '>', chr(10) ORDER BY turn) AS lines FROM v_history GROUP BY ALL),
    conversation AS (SELECT h.conv_id, concat_ws(chr(10), CASE WHEN h.summary <> '' THEN '<summary>' || h.summary || '</summary>' END, l.lines) AS conversation
                     FROM v_requests h LEFT JOIN lines l USING (conv_id))"""


@query("conversation_text", CONVERSATION + " SELECT conv_id, conversation FROM conversation")
def conversation_text(spark, sf):
    return prompts.conversation_text(r.history(spark, sf), "conv_id", r.requests(spark, sf).select("conv_id", "summary"))


CONFIRMED = (
    "CASE WHEN len(symptoms) > 0 THEN '"
    + fixed.CONFIRMED_BLOCK.format(many="symptoms", one="symptom", lines="' || array_to_string(symptoms, chr(10)) || '")
    + "' ELSE '' END || CASE WHEN diseases IS NULL THEN '' WHEN len(diseases) = 0 THEN '"
    + fixed.CONFIRMED_NONE
    + "' ELSE '"
    + fixed.CONFIRMED_BLOCK.format(many="diseases", one="disease", lines="' || array_to_string(diseases, chr(10)) || '")
    + "' END"
)


@query("confirmed_text", f"SELECT conv_id, {CONFIRMED} AS confirmed FROM v_requests")
def confirmed_text(spark, sf):
    text = prompts.confirmed_text(F.col("symptoms"), F.col("diseases"))
    return r.requests(spark, sf).select("conv_id", text.alias("confirmed"))


@query("search_query", "SELECT conv_id, query FROM v_searched")
def search_query(spark, sf):
    return hist.search_query(r.history(spark, sf), r.requests(spark, sf), "conv_id")


@query("confirmed_terms_union", """
    SELECT conv_id, CASE WHEN coalesce(len(symptoms), 0) + coalesce(len(diseases), 0) > 0
      THEN left(array_to_string(list_concat(coalesce(symptoms, []), coalesce(diseases, [])), chr(10)), 8000) ELSE query END AS searched
    FROM v_searched""")
def confirmed_terms_union(spark, sf):
    asked = r.requests(spark, sf)
    found = hist.search_query(r.history(spark, sf), asked, "conv_id").join(asked, "conv_id")
    return found.select("conv_id", hist.searched_text(F.col("query"), F.col("symptoms"), F.col("diseases")).alias("searched"))


@query("confirmed_terms", """
    SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, '.'), lambda t: regexp_replace(t, '^\\s+|\\s+$', '', 'g')), lambda t: t <> ''), '|') AS terms
    FROM v_turns""")
def confirmed_terms(spark, sf):
    rows = hist.confirmed_terms(F.split("text", r"\."))
    return v.turns(spark, sf).select("conv_id", "turn", F.array_join(rows, "|").alias("terms"))


@query("context_chars", """
    SELECT q.conv_id, count(h.turn) AS turns, CAST(coalesce(sum(length(h.text)), 0) + coalesce(any_value(length(q.summary)), 0) AS BIGINT) AS chars
    FROM v_requests q LEFT JOIN v_history h USING (conv_id) GROUP BY ALL""")
def context_chars(spark, sf):
    return hist.context_chars(r.history(spark, sf), "conv_id", r.requests(spark, sf))


@query("should_compact", """
    SELECT conv_id, turns > 2 AND greatest(chars / 4000, turns / 8) >= 0.8 AS compact FROM (
      SELECT q.conv_id, count(h.turn) AS turns, coalesce(sum(length(h.text)), 0) + coalesce(any_value(length(q.summary)), 0) AS chars
      FROM v_requests q LEFT JOIN v_history h USING (conv_id) GROUP BY ALL)""")
def should_compact(spark, sf):
    found = hist.context_chars(r.history(spark, sf), "conv_id", r.requests(spark, sf))
    return found.select("conv_id", hist.should_compact(F.col("chars"), F.col("turns"), 4000, 8).alias("compact"))


@query("advance_history", """
    WITH n AS (SELECT conv_id, count(*) AS n FROM v_turns GROUP BY ALL),
    grown AS (SELECT conv_id, turn, role, text FROM v_turns
      UNION ALL SELECT q.conv_id, n.n, 'user', q.message FROM v_requests q JOIN n USING (conv_id)
      UNION ALL SELECT q.conv_id, n.n + 1, 'assistant', trim(left(q.message || ' answered', 4000)) FROM v_requests q JOIN n USING (conv_id)),
    last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS p FROM grown) WHERE p <= 8),
    used AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM last)
    SELECT u.conv_id, u.turn, u.role, u.text FROM used u JOIN v_requests q USING (conv_id)
    WHERE u.used <= 4000 - coalesce(length(q.summary), 0)""")
def advance_history(spark, sf):
    exchanges = r.requests(spark, sf).select(
        "conv_id", "message", F.concat("message", F.lit(" answered")).alias("answer"), "summary"
    )
    return hist.advance_history(v.turns(spark, sf), exchanges, "conv_id", max_turns=8, max_chars=4000)


@query("compact_split", """
    SELECT conv_id, turn, turn >= count(*) OVER (PARTITION BY conv_id) - 2 AS kept FROM v_turns""")
def compact_split(spark, sf):
    return hist.compact_split(v.turns(spark, sf).select("conv_id", "turn"), "conv_id")


@query("compaction_prompt", CONVERSATION + f"""
    SELECT conv_id, '{fixed.CONVERSATION_HEAD}' || right(conversation, 1500 - {len(fixed.CONVERSATION_HEAD)} - {len(fixed.COMPACTION_TAIL)})
      || '{fixed.COMPACTION_TAIL}' AS prompt FROM conversation""")
def compaction_prompt(spark, sf):
    text = prompts.conversation_text(r.history(spark, sf), "conv_id", r.requests(spark, sf).select("conv_id", "summary"))
    return text.select("conv_id", prompts.compaction_prompt(F.col("conversation"), 1500).alias("prompt"))


@query("prompt_packing", """
    SELECT query_id, number, left(part, CAST(available - before AS BIGINT)) AS part FROM (
      SELECT query_id, id % 10 + 1 AS number, content AS part, 3000 + (query_id % 40) * 100 AS available,
             coalesce(sum(length(content)) OVER (PARTITION BY query_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM (SELECT *, id // 10 AS query_id FROM v_passages)) WHERE before < available""")
def prompt_packing(spark, sf):
    """Ten passages for each query, the more queries the more passages there are."""
    parts = v.passages(spark, sf, vectors=False).select(
        F.floor(F.col("id") / 10).alias("query_id"), (F.col("id") % 10 + 1).alias("number"), F.col("content").alias("part")
    )
    budgets = parts.select("query_id").distinct().withColumn("available", F.lit(3000) + (F.col("query_id") % 40) * 100)
    return prompts.pack_excerpts(parts, budgets, "query_id")
