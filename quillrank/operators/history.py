"""Histories of conversations: (key, turn, role, text) with a dense 0-based ``turn``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions import fixed_values as fixed
from quillrank.functions.words import strip
from quillrank.operators.ordered import top_k


def context_chars(turns: DataFrame, key: str, headers: DataFrame) -> DataFrame:
    """Turns and characters of each conversation; ``chars`` counts the summary as well."""
    summed = turns.groupBy(key).agg(
        F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).cast("long").alias("_chars")
    )
    summary = F.coalesce(F.length("summary"), F.lit(0))
    return headers.join(summed, key, "left").select(
        key,
        F.coalesce("turns", F.lit(0).cast("long")).alias("turns"),
        (F.coalesce("_chars", F.lit(0).cast("long")) + summary).alias("chars"),
    )


def should_compact(chars: Column, turns: Column, max_chars: int, max_turns: int) -> Column:
    full = F.greatest(chars / F.lit(max_chars), turns / F.lit(max_turns))
    return (turns > fixed.KEPT_TURNS) & (full >= fixed.COMPACT_FROM)


def advance_history(
    turns: DataFrame,
    exchanges: DataFrame,
    key: str,
    max_turns: int = fixed.MAX_HISTORY_TURNS,
    max_chars: int = fixed.MAX_HISTORY_CHARS,
) -> DataFrame:
    """The history after an exchange (key, message, answer, summary): the longest fitting end of it.

    Only the last ``max_turns`` turns of a conversation reach the running sum.
    """
    lengths = turns.groupBy(key).agg((F.max("turn") + 1).alias("_n"))
    placed = exchanges.join(lengths, key, "left").withColumn("_n", F.coalesce("_n", F.lit(0).cast("long")))
    answer = strip(F.left("answer", F.lit(fixed.MAX_TURN_CHARS)))
    added = placed.select(
        key,
        F.explode(
            F.array(
                F.struct(F.col("_n").alias("turn"), F.lit("user").alias("role"), F.col("message").alias("text")),
                F.struct((F.col("_n") + 1).alias("turn"), F.lit("assistant").alias("role"), answer.alias("text")),
            )
        ).alias("t"),
    ).select(key, "t.*")
    recent = top_k(turns.select(key, "turn", "role", "text").unionByName(added), [key], [F.col("turn").desc()], max_turns, "_place")
    back = Window.partitionBy(key).orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    budget = exchanges.select(key, (F.lit(max_chars) - F.coalesce(F.length("summary"), F.lit(0))).alias("_room"))
    return (
        recent.withColumn("_used", F.sum(F.length("text")).over(back))
        .join(budget, key)
        .filter(F.col("_used") <= F.col("_room"))
        .select(key, "turn", "role", "text")
    )


def search_query(history: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """(key, query): the last questions and the message, on lines, cut at the front."""
    asked = top_k(
        history.filter(F.col("role") == "user"), [key], [F.col("turn").desc()], fixed.PREVIOUS_QUESTIONS, "_place"
    )
    earlier = asked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("_asked"))
    texts = F.coalesce(F.transform("_asked", lambda t: t["text"]), F.array().cast("array<string>"))
    whole = F.array_join(F.concat(texts, F.array("message")), "\n")
    return requests.join(earlier, key, "left").select(
        key, F.right(whole, F.lit(fixed.MAX_QUERY_CHARS)).alias("query")
    )


def searched_text(query: Column, symptoms: Column, diseases: Column) -> Column:
    """Confirmed symptoms and diseases stand in for the query they were read from."""
    none = F.array().cast("array<string>")
    confirmed = F.concat(F.coalesce(symptoms, none), F.coalesce(diseases, none))
    return F.when(
        F.size(confirmed) > 0, F.left(F.array_join(confirmed, "\n"), F.lit(fixed.MAX_QUERY_CHARS))
    ).otherwise(query)


def confirmed_terms(rows: Column) -> Column:
    """Rows as a user left them, trimmed and without the blank ones."""
    return F.filter(F.transform(rows, strip), lambda row: row != "")


def compact_split(turns: DataFrame, key: str) -> DataFrame:
    """``kept`` marks the latest exchange; the other turns are the ones to condense."""
    last = top_k(turns.select(key, "turn"), [key], [F.col("turn").desc()], fixed.KEPT_TURNS, "_place")
    since = last.groupBy(key).agg(F.min("turn").alias("_since"))
    return turns.join(since, key).withColumn("kept", F.col("turn") >= F.col("_since")).drop("_since")
