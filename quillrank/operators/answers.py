"""Answers that arrive in pieces: (answer_id, seq, text) with a dense 0-based ``seq``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.functions.fixed_values import MAX_ANSWER_CHARS
from quillrank.functions.words import SPACE, cut, strip, strip_end
from quillrank.operators.ordered import running_before


def stream_cap(pieces: DataFrame, cap: int = MAX_ANSWER_CHARS) -> DataFrame:
    """The pieces, or parts of them, within the first ``cap`` characters of each answer."""
    placed = running_before(pieces, ["answer_id"], "seq", F.length("text"), "_before")
    left = (F.lit(cap) - F.col("_before")).cast("int")
    return placed.filter((F.col("_before") < cap) & (F.length("text") > 0)).select(
        "answer_id", "seq", F.left("text", left).alias("text")
    )


def assemble(pieces: DataFrame, finishes: DataFrame, cap: int = MAX_ANSWER_CHARS) -> DataFrame:
    """(answer_id, answer, failed): ``exhausted`` when the model ran out, ``empty`` when it said nothing.

    An answer is trimmed and cut to ``cap`` characters. Blank pieces at its ends are left out first,
    so that only pieces that reach the result are gathered, however long the answer was.
    """
    spoken = strip(F.col("text")) != ""
    edges = pieces.filter(spoken).groupBy("answer_id").agg(F.min("seq").alias("_first"), F.max("seq").alias("_last"))
    inside = pieces.join(edges, "answer_id").filter((F.col("seq") >= F.col("_first")) & (F.col("seq") <= F.col("_last")))
    start = F.regexp_replace("text", f"^{SPACE}+", "")
    body = (
        inside.withColumn("text", F.when(F.col("seq") == F.col("_first"), start).otherwise(F.col("text")))
        .withColumn("text", F.when(F.col("seq") == F.col("_last"), strip_end(F.col("text"))).otherwise(F.col("text")))
        .select("answer_id", (F.col("seq") - F.col("_first")).alias("seq"), "text")
    )
    totals = body.groupBy("answer_id").agg(F.sum(F.length("text")).alias("_total"))
    placed = running_before(body, ["answer_id"], "seq", F.length("text"), "_before").filter(F.col("_before") < cap)
    joined = placed.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("_p"))
    text = F.array_join(F.transform("_p", lambda p: p["text"]), "")
    whole = joined.join(totals, "answer_id").select(
        "answer_id", F.when(F.col("_total") > cap, F.concat(cut(text, cap), F.lit("…"))).otherwise(text).alias("_answer")
    )
    failed = F.when(F.col("finish") == "length", F.lit("exhausted")).when(F.col("_answer").isNull(), F.lit("empty"))
    return (
        finishes.join(whole, "answer_id", "left")
        .withColumn("failed", failed)
        .select("answer_id", F.when(failed.isNull(), F.col("_answer")).alias("answer"), "failed")
    )
