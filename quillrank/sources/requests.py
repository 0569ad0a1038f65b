"""Requests, replies and answers as views over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.sources.views import diseases, table, turns


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """conversations as model replies: lines with markers, labels, headings and refusals added."""
    number = F.col("conv_id") * 1000 + F.col("turn")
    text = F.replace("text", F.lit("\n"), F.lit("\n- **"))
    first = (
        F.when(F.col("turn") % 4 == 0, F.lit("Here they are:\n1. "))
        .when(F.col("turn") % 4 == 1, F.lit("* Disease: "))
        .when(F.col("turn") % 4 == 2, F.lit("None.\n"))
        .otherwise(F.lit("No diseases are named.\n2) "))
    )
    return turns(spark, sf).select(
        number.alias("reply_id"), "conv_id", "turn", F.concat(first, text, F.lit("\n• "), F.lower("text")).alias("reply")
    )


def kind_replies(spark: SparkSession, sf: str) -> DataFrame:
    head = F.when(F.col("turn") % 3 == 0, F.lit(" Question.\n")).when(F.col("turn") % 3 == 1, F.lit("CASE ")).otherwise(F.lit("questions "))
    return turns(spark, sf).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("reply_id"), F.concat(head, "text").alias("reply")
    )


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """conversations' answers with labels, and how many sources each has."""
    label = F.format_string(
        " See [%d], [2-%d], [1, %d] and [9](x); [5–40] [7-3] [2, 4-5] [3]", "turn", F.col("turn") + 3, F.col("conv_id") % 7
    )
    marked = F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, F.col("text")).otherwise(F.concat("text", label))
    return (
        turns(spark, sf)
        .filter(F.col("role") == "assistant")
        .select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"),
            marked.alias("answer"),
            (F.col("conv_id") % 9).alias("sources"),
        )
    )


def _last_questions(spark: SparkSession, sf: str) -> DataFrame:
    return (
        turns(spark, sf)
        .filter(F.col("role") == "user")
        .groupBy("conv_id")
        .agg(F.max("turn").alias("asked_at"), F.max_by("text", "turn").alias("message"))
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """One request per conversation: its last question, with lists that are unset, empty or given."""
    number = F.col("conv_id")
    none = F.array().cast("array<string>")
    named = diseases(spark, sf).withColumnRenamed("case_id", "conv_id")
    symptom = F.array(
        F.concat(F.lit("symptom a of "), number.cast("string")), F.concat(F.lit("symptom b of "), number.cast("string"))
    )
    return (
        _last_questions(spark, sf)
        .join(named, "conv_id", "left")
        .select(
            "conv_id",
            "message",
            F.when(number % 3 == 0, F.concat(F.lit("Earlier, "), F.left("message", F.lit(40)))).alias("summary"),
            F.when(number % 3 == 1, none).when(number % 3 == 2, symptom).alias("symptoms"),
            F.when(number % 4 == 1, none)
            .when((number % 4 >= 2) & F.col("disease").isNotNull(), F.array("disease"))
            .alias("diseases"),
        )
    )


def history(spark: SparkSession, sf: str) -> DataFrame:
    """The turns before a conversation's last question, between the user and the assistant."""
    return (
        turns(spark, sf)
        .filter(F.col("role").isin("user", "assistant"))
        .join(_last_questions(spark, sf).select("conv_id", "asked_at"), "conv_id")
        .filter(F.col("turn") < F.col("asked_at"))
        .select("conv_id", "turn", "role", "text")
    )


def forwarded(spark: SparkSession, sf: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    header = (
        F.when(F.col("event_id") % 4 == 1, F.concat(F.lit("1.2.3.4, 10.0.0."), user))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit("192.168.1."), user, F.lit("  ")))
        .when(F.col("event_id") % 4 == 3, F.lit("1.2.3.4, "))
    )
    return table(spark, sf, "events").select("event_id", header.alias("forwarded"))


def addresses(spark: SparkSession, sf: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    hexed = F.lower(F.hex("user_id"))
    address = (
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("203.0.113."), user))
        .when(F.col("event_id") % 5 == 1, F.concat(F.lit("2001:0DB8:0:"), hexed, F.lit("::7")))
        .when(F.col("event_id") % 5 == 2, F.concat(F.lit("::ffff:203.0.113."), user))
        .when(F.col("event_id") % 5 == 3, F.concat(F.lit("fe80::1%eth"), user))
        .otherwise(F.lit("::1"))
    )
    # The last number of an IPv4 address ends at 255, so larger users share one.
    return table(spark, sf, "events").withColumn("user_id", F.col("user_id") % 256).select("event_id", address.alias("address"))


def question_replies(spark: SparkSession, sf: str) -> DataFrame:
    """The stored reply to each conversation's last question; every tenth call failed."""
    last = _last_questions(spark, sf).select("conv_id", F.col("asked_at").alias("turn"))
    failed = F.when(F.col("conv_id") % 10 == 9, F.lit("timeout"))
    return replies(spark, sf).join(last, ["conv_id", "turn"]).select("conv_id", "reply", failed.alias("error"))


def request_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, embedding) of what each request searches by."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("conv_id"), "embedding")


def symptom_vectors(spark: SparkSession, sf: str, symptoms: DataFrame) -> DataFrame:
    """Symptoms (conv_id, ord, item) with a vector each, as (case_id, symptom_ord, symptom, embedding)."""
    embeddings = table(spark, sf, "embeddings")
    # The number of vectors is one row; the keys below stay within it.
    total = embeddings.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    keyed = symptoms.withColumn("vec_id", (F.col("conv_id") * 7 + F.col("ord") * 3) % total)
    return keyed.join(embeddings.select("vec_id", "embedding"), "vec_id").select(
        F.col("conv_id").alias("case_id"), F.col("ord").alias("symptom_ord"), F.col("item").alias("symptom"), "embedding"
    )
