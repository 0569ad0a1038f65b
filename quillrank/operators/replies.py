"""Lists parsed from model replies, and the model call itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions import words
from quillrank.functions.fixed_values import MAX_DISEASES, MAX_SYMPTOMS
from quillrank.operators.ordered import top_k
from quillrank.sources.shared import materialise, path_exists


def distinct_keep_first(items: DataFrame, key: str, position: str, text: str, limit: int) -> DataFrame:
    """Each text once, ignoring case, in its first wording and place; the first ``limit`` of a key."""
    first = items.groupBy(key, F.lower(text).alias("_lower")).agg(F.min(F.struct(position, text)).alias("_first"))
    return top_k(first.select(key, "_first.*"), [key], [F.col(position).asc()], limit, "ord").withColumn(
        "ord", F.col("ord").cast("long")
    )


def lines_of(replies: DataFrame, key: str, reply: str = "reply") -> DataFrame:
    """(key, line_no, line) of each reply; lines keep their order but leave no gaps to fill."""
    lines = replies.select(key, F.posexplode_outer(words.reply_lines(F.col(reply))).alias("line_no", "line"))
    return lines.filter(F.col("line").isNotNull())


def parse_list(replies: DataFrame, key: str, of_line: Callable[[Column], Column], limit: int) -> DataFrame:
    items = lines_of(replies, key).select(key, "line_no", of_line(F.col("line")).alias("item"))
    return distinct_keep_first(items.filter(F.col("item").isNotNull()), key, "line_no", "item", limit).select(
        key, "ord", "item"
    )


def parse_symptoms(replies: DataFrame, key: str) -> DataFrame:
    return parse_list(replies, key, words.symptom_of, MAX_SYMPTOMS)


def parse_diseases(replies: DataFrame, key: str) -> DataFrame:
    return parse_list(replies, key, words.disease_of, MAX_DISEASES)


def model_replies(
    prompts: DataFrame,
    key: str,
    generate: Callable[[list[str]], list[str]],
    text: str = "text",
    wrap: str | None = "case",
) -> DataFrame:
    """(key, reply, error) of a caller's batch model, for texts inside ``wrap`` tags.

    A batch that fails is asked again prompt by prompt, so that only the prompts that fail by
    themselves have ``error`` set.
    """
    key_type = prompts.schema[key].dataType.simpleString()
    tagged = F.col(text) if wrap is None else F.concat(F.lit(f"<{wrap}>\n"), F.col(text), F.lit(f"\n</{wrap}>"))
    asked = prompts.select(key, tagged.alias("prompt"))

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def ask(prompts: list[str]) -> tuple[list, list]:
            try:
                replies = list(generate(prompts))
                if len(replies) != len(prompts):
                    raise ValueError("one reply per prompt is required")
                return replies, [None] * len(prompts)
            except Exception as error:  # noqa: BLE001 - reported per row
                if len(prompts) == 1:
                    return [None], [f"{type(error).__name__}: {error}"]
                each = [ask([prompt]) for prompt in prompts]
                return [reply for (reply,), _ in each], [error for _, (error,) in each]

        for batch in batches:
            replies, errors = ask(batch["prompt"].tolist())
            yield pd.DataFrame({key: batch[key], "reply": replies, "error": errors})

    return asked.mapInPandas(call, f"`{key}` {key_type}, reply string, error string")


STORED = "digest string, reply string, error string, attempt long"


class ReplyStore:
    """Replies of a model by their prompt's digest, so that a run that stopped or failed in part asks only what is left.

    A run writes its replies as a folder of their own; of one prompt the reply of the latest attempt counts. A prompt that
    failed is asked again until ``attempts`` runs have tried it.
    """

    def __init__(self, spark: SparkSession, folder: str, attempts: int = 3):
        self.spark, self.folder, self.attempts = spark, folder.rstrip("/"), attempts

    def runs(self) -> int:
        number = 0
        while path_exists(self.spark, f"{self.folder}/{number}/_SUCCESS"):
            number += 1
        return number

    def stored(self) -> DataFrame:
        paths = [f"{self.folder}/{number}" for number in range(self.runs())]
        if not paths:
            return self.spark.createDataFrame([], STORED)
        rows = self.spark.read.schema(STORED).parquet(*paths)
        return rows.groupBy("digest").agg(F.max(F.struct("attempt", "reply", "error")).alias("r")).select("digest", "r.reply", "r.error", "r.attempt")

    def ask(self, prompts: DataFrame, key: str, generate: Callable[[list[str]], list[str]], text: str = "text", wrap: str | None = "case") -> DataFrame:
        """(key, reply, error, attempt) of each prompt; equal prompts are asked once."""
        tagged = F.col(text) if wrap is None else F.concat(F.lit(f"<{wrap}>\n"), F.col(text), F.lit(f"\n</{wrap}>"))
        keyed = prompts.select(key, tagged.alias("prompt")).withColumn("digest", F.sha2(F.col("prompt").cast("binary"), 256))
        known = self.stored()
        done = known.where(F.col("error").isNull() | (F.col("attempt") >= self.attempts))
        left = keyed.groupBy("digest").agg(F.first("prompt").alias("prompt")).join(done.select("digest"), "digest", "left_anti")
        tried = left.join(known.select("digest", "attempt"), "digest", "left").select("digest", "prompt", F.coalesce("attempt", F.lit(0).cast("long")).alias("attempt"))
        tried = materialise(tried, "unanswered")
        if tried.head(1):
            replies = model_replies(tried, "digest", generate, "prompt", None)
            counted = replies.join(tried.select("digest", "attempt"), "digest").select("digest", "reply", "error", (F.col("attempt") + 1).alias("attempt"))
            counted.write.mode("overwrite").parquet(f"{self.folder}/{self.runs()}")
        return keyed.drop("prompt").join(self.stored(), "digest").drop("digest")
