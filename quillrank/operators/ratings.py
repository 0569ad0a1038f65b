"""Feedback: ids, latest values and the fold of rating events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.functions.citing import cited_numbers
from quillrank.functions.words import strip


def split_feedback_id(feedback: DataFrame) -> DataFrame:
    """The chat and the message of a ``chat-message`` id; ids without a numeric message are dropped.

    A chat's id may itself hold dashes, so only the last part is read as the message.
    """
    pattern = r"^(.*)-(\d+)\z"
    return feedback.filter(F.col("feedback_id").rlike(pattern)).select(
        "*",
        F.regexp_extract("feedback_id", pattern, 1).alias("chat_id"),
        F.regexp_extract("feedback_id", pattern, 2).cast("long").alias("message_id"),
    )


def feedback_of_chat(feedback: DataFrame, chat_id: str) -> DataFrame:
    """One chat's feedback: the prefix reaches the scan, and other chats it also fits are dropped."""
    listed = split_feedback_id(feedback.filter(F.col("feedback_id").startswith(f"{chat_id}-")))
    return listed.filter(F.col("chat_id") == chat_id)


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the greatest ``order`` of each key: a later save replaces an earlier one."""
    rest = [name for name in rows.columns if name not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*keys, "_last.*")


def with_defaults(feedback: DataFrame) -> DataFrame:
    """Feedback saved before reasons and comments existed has none."""
    return feedback.withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))


def rated_sources(ratings) -> object:
    """An array of ratings, one for each source, as a map from the source's number to its rating."""
    numbered = F.transform(ratings, lambda rating, i: F.struct((i + 1).alias("number"), rating.alias("rating")))
    return F.map_from_entries(F.filter(numbered, lambda entry: entry["rating"].isNotNull()))


def fold_ratings(events: DataFrame, keys: list[str]) -> DataFrame:
    """Current ratings of each answer from its events, in the order of ``seq``.

    An event has a ``kind``: ``answer`` sets or clears (NULL) the answer's rating, ``source`` that of
    the source ``number``, ``reasons`` and ``comment`` set a note; a comment is trimmed, and blank is none. Reasons go whenever the answer's
    rating becomes other than down. Every part is the last of its kind, so the fold is a set of
    maxima: it combines before the shuffle and holds no list of events.
    """
    kind = F.col("kind")
    down = F.coalesce(F.col("rating") == "down", F.lit(False))
    # A key without events of a kind gives a NULL struct, and the fields below are NULL with it.
    last_answer = F.max(F.when(kind == "answer", F.struct("seq", "rating")))
    last_reasons = F.max(F.when(kind == "reasons", F.struct("seq", "reasons")))
    last_comment = F.max(F.when(kind == "comment", F.struct("seq", "comment")))
    cleared = F.max(F.when((kind == "answer") & ~down, F.col("seq")))
    main = events.groupBy(*keys).agg(
        last_answer.alias("a"), last_reasons.alias("r"), last_comment.alias("c"), cleared.alias("cleared")
    )
    stands = F.col("r").isNotNull() & (F.col("cleared").isNull() | (F.col("r.seq") > F.col("cleared")))
    return main.select(
        *keys,
        F.col("a.rating").alias("rating"),
        F.when(stands, F.col("r.reasons")).alias("reasons"),
        F.nullif(strip(F.col("c.comment")), F.lit("")).alias("comment"),
    )


def fold_source_ratings(events: DataFrame, keys: list[str]) -> DataFrame:
    """The sources that are rated now: the last rating of each, unless that took it back."""
    last = events.filter(F.col("kind") == "source").groupBy(*keys, "number").agg(
        F.max_by("rating", "seq").alias("rating")
    )
    return last.filter(F.col("rating").isNotNull())


def cited_flags(answers: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """Sources (keys, number, …) with ``cited``: whether the ``answer`` of their keys names their number."""
    numbers = answers.select(*keys, cited_numbers(F.col("answer")).alias("_cited"))
    flag = F.coalesce(F.array_contains("_cited", F.col("number")), F.lit(False))
    return sources.join(numbers, keys).withColumn("cited", flag).drop("_cited")


def feedback_records(answers: DataFrame, sources: DataFrame, main: DataFrame, rated: DataFrame, keys: list[str]) -> DataFrame:
    """What is kept for each answer that can be rated: question, answer, rating, sources, reasons and comment.

    ``answers`` are those of ``rateable_answers``; ``sources`` (keys, number, id), at most a search's limit for each answer; ``main`` and
    ``rated`` the folded ratings of answers and of sources. An answer that nobody rated has a record without ratings.
    """
    flagged = cited_flags(answers, sources, keys).join(rated.select(*keys, "number", "rating"), [*keys, "number"], "left")
    listed = flagged.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("number", "id", "cited", "rating"))).alias("_s"))
    known = answers.join(listed, keys, "left").join(main.select(*keys, "rating", "reasons", "comment"), keys, "left")
    none = F.array().cast("array<struct<id: string, cited: boolean, rating: string>>")
    each = F.transform("_s", lambda s: F.struct(s["id"].alias("id"), s["cited"].alias("cited"), s["rating"].alias("rating")))
    return with_defaults(known.select(*keys, "question", "answer", "rating", F.coalesce(each, none).alias("sources"), "reasons", "comment"))
