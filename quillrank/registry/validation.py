"""Queries of the rules for requests, chats and feedback."""

from __future__ import annotations

from quillrank.operators import validate as val
from quillrank.registry import query
from quillrank.sources.bodies import CHATS, COMPACTS, FEEDBACK, REQUESTS, bodies, bodies_sql

PARSED = "WITH b AS ({body}), p AS (SELECT conv_id, turn, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS v FROM b)"
STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def text_error(value: str, name: str) -> str:
    """The first error of a turn's text, given its JSON value."""
    text = f"json_extract_string({value}, '$')"
    return f"""CASE WHEN json_type({value}) IS DISTINCT FROM 'VARCHAR' THEN '{name} must be a string'
      WHEN {text} = '' THEN '{name} must not be empty' WHEN length({text}) > 4000 THEN '{name} must not exceed 4000 characters'
      WHEN {STRIP.format(x=text)} = '' THEN '{name} must not be blank' END"""


def history_error(value: str) -> str:
    turn = f"""coalesce(CASE WHEN json_type(t) <> 'OBJECT' THEN 'invalid history' END,
      CASE WHEN json_type(t, '$.role') IS DISTINCT FROM 'VARCHAR' OR json_extract_string(t, '$.role') NOT IN ('user', 'assistant')
        THEN 'role must be "user" or "assistant"' END, {text_error("json_extract(t, '$.content')", "content")},
      CASE WHEN len(list_filter(json_keys(t), lambda k: k NOT IN ('role', 'content'))) > 0 THEN 'invalid history' END)"""
    return f"""CASE WHEN json_type({value}) IS DISTINCT FROM 'ARRAY' THEN 'invalid history'
      ELSE coalesce(list_filter(list_transform(CAST({value} AS JSON[]), lambda t: {turn}), lambda e: e IS NOT NULL)[1],
        CASE WHEN json_array_length({value}) > 20 THEN 'history must not exceed 20 turns' END) END"""


def confirmed_error(value: str, one: str, many: str) -> str:
    text = STRIP.format(x="json_extract_string(t, '$')")
    entry = f"""CASE WHEN json_type(t) <> 'VARCHAR' THEN 'a {one} must be a string' WHEN {text} = '' THEN 'a {one} must not be blank'
      WHEN length({text}) > 200 THEN 'a {one} must not exceed 200 characters' END"""
    return f"""CASE WHEN json_type({value}) IS DISTINCT FROM 'ARRAY' THEN '{many} must be a list'
      ELSE coalesce(list_filter(list_transform(CAST({value} AS JSON[]), lambda t: {entry}), lambda e: e IS NOT NULL)[1],
        CASE WHEN json_array_length({value}) > 15 THEN '{many} must not exceed 15' END) END"""


def optional(value: str, rule: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN NULL ELSE {rule} END"


def unknown(value: str, names: list[str]) -> str:
    listed = ", ".join(f"'{name}'" for name in names)
    return f"len(list_filter(json_keys({value}), lambda k: k NOT IN ({listed}))) > 0"


def member(name: str) -> str:
    return f"json_extract(v, '$.{name}')"


CONTEXT = f"""coalesce(list_sum(list_transform(CAST({member("history")} AS JSON[]),
    lambda t: length({STRIP.format(x="json_extract_string(t, '$.content')")}))), 0)
    + coalesce(length({STRIP.format(x="json_extract_string(v, '$.summary')")}), 0)"""
NOT_JSON = "CASE WHEN v IS NULL THEN 'request body must be valid JSON' WHEN json_type(v) <> 'OBJECT' THEN 'invalid {what}' END"


def whole(value: str) -> str:
    return f"""(json_type({value}) IN ('BIGINT', 'UBIGINT', 'DOUBLE') AND CAST({value} AS DOUBLE) >= 0
      AND CAST({value} AS DOUBLE) = floor(CAST({value} AS DOUBLE)))"""


def short(value: str, most: int, least: int = 0) -> str:
    return f"(json_type({value}) = 'VARCHAR' AND length(json_extract_string({value}, '$')) BETWEEN {least} AND {most})"


def each(value: str, name: str, test: str) -> str:
    """Whether every element passes; a test that is NULL does not."""
    return f"len(list_filter(CAST({value} AS JSON[]), lambda {name}: NOT coalesce({test}, false))) = 0"


@query("validate_requests", PARSED.format(body=bodies_sql(REQUESTS)) + f""",
    e AS (SELECT conv_id, turn, v, coalesce({NOT_JSON.format(what="request")}, {text_error(member("message"), "message")},
      {optional(member("history"), history_error(member("history")))},
      {optional(member("summary"), text_error(member("summary"), "summary"))},
      {optional(member("symptoms"), confirmed_error(member("symptoms"), "symptom", "symptoms"))},
      {optional(member("diseases"), confirmed_error(member("diseases"), "disease", "diseases"))},
      CASE WHEN {unknown("v", ["message", "history", "summary", "symptoms", "diseases"])} THEN 'unexpected request field' END,
      CASE WHEN {CONTEXT} > 16000 THEN 'history must not exceed 16000 characters' END) AS error FROM p)
    SELECT conv_id, turn, error, CASE WHEN error IS NULL THEN {STRIP.format(x="json_extract_string(v, '$.message')")} END AS message FROM e""")
def validate_requests(spark, sf):
    return val.validate_requests(bodies(spark, sf, REQUESTS)).select("conv_id", "turn", "error", "message")


@query("validate_compact", PARSED.format(body=bodies_sql(COMPACTS)) + f"""
    SELECT conv_id, turn, coalesce({NOT_JSON.format(what="request")}, {history_error(member("history"))},
      {optional(member("summary"), text_error(member("summary"), "summary"))},
      CASE WHEN {unknown("v", ["history", "summary"])} THEN 'unexpected request field' END,
      CASE WHEN {CONTEXT} > 16000 THEN 'history must not exceed 16000 characters' END,
      CASE WHEN json_array_length({member("history")}) <= 2 THEN 'there is nothing to compact' END) AS error FROM p""")
def validate_compact(spark, sf):
    return val.validate_compact(bodies(spark, sf, COMPACTS)).select("conv_id", "turn", "error")


def inner(value: str, name: str) -> str:
    return f"json_extract({value}, '$.{name}')"


CITATION = " AND ".join(
    [f"json_type(s) = 'OBJECT'"]
    + [short(inner("s", name), 500) for name in ("id", "bookId", "bookTitle", "sectionTitle")]
    + [f"(json_type({inner('s', name)}) = 'NULL' OR {short(inner('s', name), 500)})" for name in ("author", "remedyName")]
    + [
        f"json_type({inner('s', 'passageIndexes')}) = 'ARRAY'",
        each(inner("s", "passageIndexes"), "i", whole("i")),
        short(inner("s", "text"), 8000),
        "NOT "
        + unknown("s", ["id", "bookId", "bookTitle", "author", "remedyName", "sectionTitle", "passageIndexes", "text"]),
    ]
)
MESSAGE = f"""json_type(m) = 'OBJECT' AND {whole(inner("m", "id"))} AND json_extract_string(m, '$.role') IN ('user', 'assistant')
    AND {short(inner("m", "content"), 12000)} AND ({inner("m", "sources")} IS NULL OR (json_type({inner("m", "sources")}) = 'ARRAY'
      AND json_array_length({inner("m", "sources")}) <= 20 AND {each(inner("m", "sources"), "s", CITATION)}))
    AND NOT {unknown("m", ["id", "role", "content", "sources"])}"""


@query("validate_chats", PARSED.format(body=bodies_sql(CHATS)) + f"""
    SELECT conv_id, turn, coalesce({NOT_JSON.format(what="chat")},
      CASE WHEN NOT coalesce({short(member("title"), 200, 1)}, false) THEN 'invalid title' END,
      CASE WHEN NOT coalesce({whole(member("updatedAt"))}, false) THEN 'invalid updatedAt' END,
      CASE WHEN json_type({member("messages")}) IS DISTINCT FROM 'ARRAY' OR json_array_length({member("messages")}) = 0 THEN 'invalid messages' END,
      CASE WHEN NOT {each(member("messages"), "m", MESSAGE)} THEN 'invalid messages' END,
      CASE WHEN json_array_length({member("messages")}) > 400 THEN 'a chat must not exceed 400 messages' END,
      {history_error(member("history"))},
      {optional(member("summary"), f"CASE WHEN NOT coalesce({short(member('summary'), 4000)}, false) THEN 'invalid summary' END")},
      CASE WHEN {unknown("v", ["title", "updatedAt", "messages", "history", "summary"])} THEN 'unexpected chat field' END) AS error FROM p""")
def validate_chats(spark, sf):
    return val.validate_chats(bodies(spark, sf, CHATS)).select("conv_id", "turn", "error")


def rating(value: str) -> str:
    return f"coalesce(json_type({value}) = 'NULL' OR json_extract_string({value}, '$') IN ('up', 'down'), false)"


SOURCE = f"""json_type(s) = 'OBJECT' AND {short(inner("s", "id"), 500)} AND json_type({inner("s", "cited")}) = 'BOOLEAN'
    AND {rating(inner("s", "rating"))} AND NOT {unknown("s", ["id", "cited", "rating"])}"""
REASONS = f"""CASE WHEN json_type({member("reasons")}) <> 'ARRAY' THEN 'invalid reasons'
    WHEN NOT {each(member("reasons"), "r", "json_extract_string(r, '$') IN ('wrong_remedy', 'irrelevant_sources', 'missing_information', 'unclear')")}
      THEN 'invalid reasons'
    WHEN len(list_distinct(CAST({member("reasons")} AS VARCHAR[]))) < json_array_length({member("reasons")}) THEN 'reasons must not repeat' END"""
COMMENT = f"""CASE WHEN json_type({member("comment")}) NOT IN ('VARCHAR', 'NULL') THEN 'invalid comment'
    WHEN length(json_extract_string(v, '$.comment')) > 1000 THEN 'comment must not exceed 1000 characters' END"""


@query("validate_feedback", PARSED.format(body=bodies_sql(FEEDBACK)) + f""",
    e AS (SELECT conv_id, turn, v, coalesce({NOT_JSON.format(what="feedback")},
      CASE WHEN NOT coalesce({short(member("question"), 4000, 1)}, false) THEN 'invalid question' END,
      CASE WHEN NOT coalesce({short(member("answer"), 12000, 1)}, false) THEN 'invalid answer' END,
      CASE WHEN NOT {rating(member("rating"))} THEN 'invalid rating' END,
      CASE WHEN json_type({member("sources")}) IS DISTINCT FROM 'ARRAY' OR json_array_length({member("sources")}) > 20
        OR NOT {each(member("sources"), "s", SOURCE)} THEN 'invalid sources' END,
      {optional(member("reasons"), REASONS)}, {optional(member("comment"), COMMENT)},
      CASE WHEN {unknown("v", ["question", "answer", "rating", "sources", "reasons", "comment"])} THEN 'unexpected feedback field' END,
      CASE WHEN coalesce(json_array_length({member("reasons")}), 0) > 0 AND coalesce(json_extract_string(v, '$.rating'), '') <> 'down'
        THEN 'only an answer rated down has reasons' END) AS error FROM p)
    SELECT conv_id, turn, error, CASE WHEN error IS NULL THEN nullif({STRIP.format(x="json_extract_string(v, '$.comment')")}, '') END AS comment FROM e""")
def validate_feedback(spark, sf):
    return val.validate_feedback(bodies(spark, sf, FEEDBACK)).select("conv_id", "turn", "error", "comment")
