"""Rules for requests, chats and feedback that arrive as JSON text.

Each rule gives the first ``error`` of a row, or NULL, in the order of the fields, then unknown
fields, then rules over several fields. Values keep their JSON type as variants, so the text "1" is
no number. Where a rule has no wording of its own the error is ``invalid <field>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.functions import fixed_values as fixed
from quillrank.functions.words import strip

NUMBER = "^(BIGINT|DECIMAL|DOUBLE)"


def field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("MISSING"))


def is_kind(value: Column, name: str) -> Column:
    return F.startswith(kind(value), F.lit(name))


def missing(value: Column) -> Column:
    return value.isNull()


def string(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def items(value: Column) -> Column:
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))


def keys(value: Column) -> Column:
    return F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))


def unknown(value: Column, allowed: list[str]) -> Column:
    return F.size(F.array_except(keys(value), F.array(*[F.lit(name) for name in allowed]))) > 0


def error(bad: Column, text: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.lit(text))


def first_of(errors: Column) -> Column:
    """The first error of an array of them."""
    return F.get(F.filter(errors, lambda e: e.isNotNull()), F.lit(0))


def is_text(value: Column, longest: int, shortest: int = 0) -> Column:
    return is_kind(value, "STRING") & F.length(string(value)).between(shortest, longest)


def is_nullable_text(value: Column, longest: int) -> Column:
    return is_kind(value, "VOID") | is_text(value, longest)


# The greatest integer up to which doubles hold every integer.
MAX_WHOLE = 9_007_199_254_740_991


def is_whole(value: Column) -> Column:
    number = F.try_variant_get(value, "$", "double")
    return kind(value).rlike(NUMBER) & (number == F.floor(number)) & number.between(0, MAX_WHOLE)


def is_one_of(value: Column, allowed: list[str]) -> Column:
    return is_kind(value, "STRING") & string(value).isin(allowed)


def turn_text(value: Column, name: str) -> Column:
    """A turn's text: its length is tested before it is trimmed."""
    text = string(value)
    return F.coalesce(
        error(~is_kind(value, "STRING"), f"{name} must be a string"),
        error(text == "", f"{name} must not be empty"),
        error(F.length(text) > fixed.MAX_TURN_CHARS, f"{name} must not exceed {fixed.MAX_TURN_CHARS} characters"),
        error(strip(text) == "", f"{name} must not be blank"),
    )


def optional(value: Column, rule: Column) -> Column:
    return F.when(missing(value), F.lit(None).cast("string")).otherwise(rule)


def history_error(history: Column) -> Column:
    """Errors of the turns first, in their order, then the number of turns."""

    def turn(value: Column) -> Column:
        return F.coalesce(
            error(~is_kind(value, "OBJECT"), "invalid history"),
            error(~is_one_of(field(value, "role"), fixed.ROLES), 'role must be "user" or "assistant"'),
            turn_text(field(value, "content"), "content"),
            error(unknown(value, ["role", "content"]), "invalid history"),
        )

    return F.coalesce(
        error(~is_kind(history, "ARRAY"), "invalid history"),
        first_of(F.transform(items(history), turn)),
        error(
            F.size(items(history)) > fixed.MAX_HISTORY_TURNS,
            f"history must not exceed {fixed.MAX_HISTORY_TURNS} turns",
        ),
    )


def confirmed_error(values: Column, one: str, many: str, most: int, longest: int) -> Column:
    """A confirmed list: its texts are trimmed before their length is tested."""

    def entry(value: Column) -> Column:
        text = strip(string(value))
        return F.coalesce(
            error(~is_kind(value, "STRING"), f"a {one} must be a string"),
            error(text == "", f"a {one} must not be blank"),
            error(F.length(text) > longest, f"a {one} must not exceed {longest} characters"),
        )

    return F.coalesce(
        error(~is_kind(values, "ARRAY"), f"{many} must be a list"),
        first_of(F.transform(items(values), entry)),
        error(F.size(items(values)) > most, f"{many} must not exceed {most}"),
    )


def context_length(history: Column, summary: Column) -> Column:
    contents = F.transform(items(history), lambda turn: F.length(strip(string(field(turn, "content")))))
    total = F.aggregate(contents, F.lit(0), lambda total, size: total + F.coalesce(size, F.lit(0)))
    return total + F.coalesce(F.length(strip(string(summary))), F.lit(0))


# What each kind of body has. A field is read from the body once and is then a column, ``_message`` and so on.
REQUEST = ["message", "history", "summary", "symptoms", "diseases"]
COMPACT = ["history", "summary"]
CHAT = ["title", "updatedAt", "messages", "history", "summary"]
RATED = ["question", "answer", "rating", "sources", "reasons", "comment"]


def _parsed(rows: DataFrame, body: str, names: list[str]) -> DataFrame:
    parsed = rows.withColumn("_v", F.try_parse_json(body))
    return parsed.select("*", *[field(F.col("_v"), name).alias(f"_{name}") for name in names])


def _values(names: list[str]) -> list[Column]:
    return [F.col("_v"), *[F.col(f"_{name}") for name in names]]


def _bare(judged: DataFrame, names: list[str]) -> DataFrame:
    return judged.drop("_v", *[f"_{name}" for name in names])


def _object_error(value: Column, what: str) -> Column:
    return F.coalesce(
        error(missing(value), "request body must be valid JSON"), error(~is_kind(value, "OBJECT"), f"invalid {what}")
    )


def judged_requests(rows: DataFrame, body: str = "body") -> DataFrame:
    """``error`` of each question, beside its fields."""
    v, message, history, summary, symptoms, diseases = _values(REQUEST)
    too_long = context_length(history, summary) > fixed.MAX_HISTORY_CHARS
    found = F.coalesce(
        _object_error(v, "request"),
        turn_text(message, "message"),
        optional(history, history_error(history)),
        optional(summary, turn_text(summary, "summary")),
        optional(symptoms, confirmed_error(symptoms, "symptom", "symptoms", fixed.MAX_SYMPTOMS, fixed.MAX_SYMPTOM_CHARS)),
        optional(diseases, confirmed_error(diseases, "disease", "diseases", fixed.MAX_DISEASES, fixed.MAX_DISEASE_CHARS)),
        error(unknown(v, REQUEST), "unexpected request field"),
        error(too_long, f"history must not exceed {fixed.MAX_HISTORY_CHARS} characters"),
    )
    return _parsed(rows, body, REQUEST).withColumn("error", found)


def validate_requests(rows: DataFrame, body: str = "body") -> DataFrame:
    """``error`` of each question, and its trimmed ``message`` when it has none."""
    message = F.when(F.col("error").isNull(), strip(string(F.col("_message"))))
    return _bare(judged_requests(rows, body).withColumn("message", message), REQUEST)


def judged_compacts(rows: DataFrame, body: str = "body") -> DataFrame:
    """``error`` of each request to condense a history, beside its fields."""
    v, history, summary = _values(COMPACT)
    found = F.coalesce(
        _object_error(v, "request"),
        history_error(history),
        optional(summary, turn_text(summary, "summary")),
        error(unknown(v, COMPACT), "unexpected request field"),
        error(
            context_length(history, summary) > fixed.MAX_HISTORY_CHARS,
            f"history must not exceed {fixed.MAX_HISTORY_CHARS} characters",
        ),
        error(F.size(items(history)) <= fixed.KEPT_TURNS, "there is nothing to compact"),
    )
    return _parsed(rows, body, COMPACT).withColumn("error", found)


def validate_compact(rows: DataFrame, body: str = "body") -> DataFrame:
    """``error`` of each request to condense a history."""
    return _bare(judged_compacts(rows, body), COMPACT)


def _is_citation(value: Column) -> Column:
    names = ["id", "bookId", "bookTitle", "author", "remedyName", "sectionTitle", "passageIndexes", "text"]
    indexes = field(value, "passageIndexes")
    tests = [is_text(field(value, name), fixed.MAX_FIELD_CHARS) for name in ("id", "bookId", "bookTitle", "sectionTitle")]
    tests += [is_nullable_text(field(value, name), fixed.MAX_FIELD_CHARS) for name in ("author", "remedyName")]
    tests += [
        is_kind(indexes, "ARRAY"),
        F.size(items(indexes)) <= fixed.MAX_PASSAGE_INDEXES,
        F.forall(items(indexes), is_whole),
        is_text(field(value, "text"), fixed.MAX_CITATION_CHARS),
        ~unknown(value, names),
    ]
    whole = is_kind(value, "OBJECT")
    for test in tests:
        whole = whole & F.coalesce(test, F.lit(False))
    return whole


def judged_chats(rows: DataFrame, body: str = "body") -> DataFrame:
    """``error`` of each whole chat that is to be saved, beside its fields."""
    v, title, updated_at, messages, history, summary = _values(CHAT)

    def is_message(value: Column) -> Column:
        sources = field(value, "sources")
        listed = missing(sources) | (
            is_kind(sources, "ARRAY")
            & (F.size(items(sources)) <= fixed.MAX_SAVED_SOURCES)
            & F.forall(items(sources), _is_citation)
        )
        return (
            is_kind(value, "OBJECT")
            & F.coalesce(is_whole(field(value, "id")), F.lit(False))
            & F.coalesce(is_one_of(field(value, "role"), fixed.ROLES), F.lit(False))
            & F.coalesce(is_text(field(value, "content"), fixed.MAX_ANSWER_CHARS), F.lit(False))
            & F.coalesce(listed, F.lit(False))
            & F.coalesce(~unknown(value, ["id", "role", "content", "sources"]), F.lit(False))
        )

    found = F.coalesce(
        _object_error(v, "chat"),
        error(~F.coalesce(is_text(title, fixed.MAX_TITLE_CHARS, 1), F.lit(False)), "invalid title"),
        error(~F.coalesce(is_whole(updated_at), F.lit(False)), "invalid updatedAt"),
        error(~is_kind(messages, "ARRAY") | (F.size(items(messages)) == 0), "invalid messages"),
        error(~F.forall(items(messages), is_message), "invalid messages"),
        error(F.size(items(messages)) > fixed.MAX_MESSAGES, f"a chat must not exceed {fixed.MAX_MESSAGES} messages"),
        history_error(history),
        optional(summary, error(~F.coalesce(is_text(summary, fixed.MAX_TURN_CHARS), F.lit(False)), "invalid summary")),
        error(unknown(v, CHAT), "unexpected chat field"),
    )
    return _parsed(rows, body, CHAT).withColumn("error", found)


def validate_chats(rows: DataFrame, body: str = "body") -> DataFrame:
    """``error`` of each whole chat that is to be saved."""
    return _bare(judged_chats(rows, body), CHAT)


def judged_feedback(rows: DataFrame, body: str = "body") -> DataFrame:
    """``error`` of each feedback, beside its fields."""
    v, question, answer, rating, sources, reasons, comment = _values(RATED)

    def is_rating(value: Column) -> Column:
        return F.coalesce(is_kind(value, "VOID") | is_one_of(value, fixed.RATINGS), F.lit(False))

    def is_source(value: Column) -> Column:
        return (
            is_kind(value, "OBJECT")
            & F.coalesce(is_text(field(value, "id"), fixed.MAX_FIELD_CHARS), F.lit(False))
            & is_kind(field(value, "cited"), "BOOLEAN")
            & is_rating(field(value, "rating"))
            & F.coalesce(~unknown(value, ["id", "cited", "rating"]), F.lit(False))
        )

    given = F.transform(items(reasons), string)
    reason_errors = F.coalesce(
        error(~is_kind(reasons, "ARRAY"), "invalid reasons"),
        error(~F.forall(items(reasons), lambda r: F.coalesce(is_one_of(r, fixed.REASONS), F.lit(False))), "invalid reasons"),
        error(F.size(F.array_distinct(given)) < F.size(given), "reasons must not repeat"),
    )
    comment_errors = F.coalesce(
        error(~(is_kind(comment, "STRING") | is_kind(comment, "VOID")), "invalid comment"),
        error(
            F.length(string(comment)) > fixed.MAX_COMMENT_CHARS,
            f"comment must not exceed {fixed.MAX_COMMENT_CHARS} characters",
        ),
    )
    found = F.coalesce(
        _object_error(v, "feedback"),
        error(~F.coalesce(is_text(question, fixed.MAX_TURN_CHARS, 1), F.lit(False)), "invalid question"),
        error(~F.coalesce(is_text(answer, fixed.MAX_ANSWER_CHARS, 1), F.lit(False)), "invalid answer"),
        error(~is_rating(rating), "invalid rating"),
        error(
            ~is_kind(sources, "ARRAY")
            | (F.size(items(sources)) > fixed.MAX_SAVED_SOURCES)
            | ~F.forall(items(sources), is_source),
            "invalid sources",
        ),
        optional(reasons, reason_errors),
        optional(comment, comment_errors),
        error(unknown(v, RATED), "unexpected feedback field"),
        error(
            (F.size(given) > 0) & (F.coalesce(string(rating), F.lit("")) != "down"),
            "only an answer rated down has reasons",
        ),
    )
    return _parsed(rows, body, RATED).withColumn("error", found)


def trimmed_comment() -> Column:
    return F.nullif(strip(string(F.col("_comment"))), F.lit(""))


def validate_feedback(rows: DataFrame, body: str = "body") -> DataFrame:
    """``error`` of each feedback; if none, its ``comment``, trimmed and NULL when blank."""
    judged = judged_feedback(rows, body).withColumn("comment", F.when(F.col("error").isNull(), trimmed_comment()))
    return _bare(judged, RATED)


# Typed rows --------------------------------------------------------------------------------------


def _turns(history: Column) -> Column:
    """Turns as structs, trimmed; none where there is no history."""
    return F.transform(
        items(history),
        lambda t: F.struct(string(field(t, "role")).alias("role"), strip(string(field(t, "content"))).alias("content")),
    )


def _listed(values: Column) -> Column:
    """A confirmed list, trimmed; NULL if it was not given."""
    return F.when(~missing(values), F.transform(items(values), lambda x: strip(string(x))))


def _given(value: Column) -> Column:
    """NULL for a JSON null as for a missing value."""
    return F.when(~is_kind(value, "VOID"), string(value))


def _number(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double").cast("long")


def _valid(judged: DataFrame, names: list[str], **made: Column) -> DataFrame:
    """The rows without an error, with typed columns."""
    fine = judged.where(F.col("error").isNull()).withColumns(made)
    return fine.drop("error", "_v", *[f"_{name}" for name in names])


def valid_requests(rows: DataFrame, body: str = "body") -> DataFrame:
    """The questions that pass: message, history (array of turns), summary, symptoms, diseases. What was put aside is in ``validate_requests``."""
    _, message, history, summary, symptoms, diseases = _values(REQUEST)
    return _valid(
        judged_requests(rows, body),
        REQUEST,
        message=strip(string(message)),
        history=_turns(history),
        summary=strip(string(summary)),
        symptoms=_listed(symptoms),
        diseases=_listed(diseases),
    )


def valid_compacts(rows: DataFrame, body: str = "body") -> DataFrame:
    """The requests to condense that pass: history and summary."""
    _, history, summary = _values(COMPACT)
    return _valid(judged_compacts(rows, body), COMPACT, history=_turns(history), summary=strip(string(summary)))


def _citations(sources: Column) -> Column:
    """Saved sources; NULL if the message has no list of them."""

    def source(value: Column) -> Column:
        texts = {"id": "id", "bookId": "book_id", "bookTitle": "book_title", "sectionTitle": "section_title", "text": "text"}
        fields = [string(field(value, name)).alias(alias) for name, alias in texts.items()]
        fields += [_given(field(value, name)).alias(alias) for name, alias in (("author", "author"), ("remedyName", "remedy_name"))]
        indexes = F.transform(items(field(value, "passageIndexes")), _number)
        return F.struct(*fields, indexes.alias("passage_indexes"))

    return F.when(~missing(sources), F.transform(items(sources), source))


def typed_messages(messages: Column) -> Column:
    return F.transform(
        items(messages),
        lambda m: F.struct(
            _number(field(m, "id")).alias("id"),
            string(field(m, "role")).alias("role"),
            string(field(m, "content")).alias("content"),
            _citations(field(m, "sources")).alias("sources"),
        ),
    )


def valid_chats(rows: DataFrame, body: str = "body") -> DataFrame:
    """The chats that may be saved: title, updated_at, messages with their sources, history, summary."""
    _, title, updated_at, messages, history, summary = _values(CHAT)
    return _valid(
        judged_chats(rows, body),
        CHAT,
        title=string(title),
        updated_at=_number(updated_at),
        messages=typed_messages(messages),
        history=_turns(history),
        summary=string(summary),
    )


def valid_feedback(rows: DataFrame, body: str = "body") -> DataFrame:
    """The feedback that passes: question, answer, rating, sources, reasons (none by default) and comment."""
    _, question, answer, rating, sources, reasons, _ = _values(RATED)
    rated = F.transform(
        items(sources),
        lambda s: F.struct(
            string(field(s, "id")).alias("id"),
            F.try_variant_get(field(s, "cited"), "$", "boolean").alias("cited"),
            _given(field(s, "rating")).alias("rating"),
        ),
    )
    return _valid(
        judged_feedback(rows, body),
        RATED,
        question=string(question),
        answer=string(answer),
        rating=_given(rating),
        sources=rated,
        reasons=F.transform(items(reasons), string),
        comment=trimmed_comment(),
    )


def split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that pass and those to be put aside with their error."""
    return validated.filter(F.col("error").isNull()).drop("error"), validated.filter(F.col("error").isNotNull())
