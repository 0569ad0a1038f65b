"""Saving chats and feedback as whole jobs: who may, how much, what is written, in a store that survives failures.

A save is refused in this order: no such id, an unverified user, a limit, an invalid body. The limit of saves counts the messages that
the store had to write, which depends on the saves before it; so a user's saves are folded in order of time,
without their bodies.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.operators import chats as ch
from quillrank.operators import limits as lim
from quillrank.operators import validate as val
from quillrank.sources.shared import materialise, path_exists

KEYS = ["user_id", "chat_id"]
BUCKETS = 64

HEADS = (
    "user_id long, chat_id string, title string, updated_at long, history array<struct<role: string, content: string>>,"
    " summary string, message_count long"
)
MESSAGES = (
    "user_id long, chat_id string, turn long, message struct<id: bigint, role: string, content: string, sources: array<struct<"
    "id: string, book_id: string, book_title: string, section_title: string, text: string, author: string, remedy_name: string,"
    " passage_indexes: array<bigint>>>>"
)
WINDOWS = "user_id long, counts array<bigint>, ends array<bigint>"
DECISIONS = (
    "user_id long, chat_id string, now_ms long, id long, status string, wait long, error string, before long, length long,"
    " counts array<bigint>, ends array<bigint>"
)


def decide(saves: DataFrame, heads: DataFrame, windows: DataFrame, limits: lim.Limits) -> DataFrame:
    """DECISIONS of saves (user_id, chat_id, now_ms, id, verified, body), with the stored count each one met (``before``) and its user's windows."""
    judged = val.judged_chats(saves).select(
        *KEYS,
        "now_ms",
        "id",
        (~F.coalesce(ch.valid_id(F.col("chat_id")), F.lit(False))).alias("odd"),
        F.coalesce("verified", F.lit(False)).alias("verified"),
        "error",
        F.size(val.items(F.col("_messages"))).cast("long").alias("length"),
    )
    known = judged.join(heads.select(*KEYS, F.col("message_count").alias("stored")), KEYS, "left").join(windows, "user_id", "left")
    ordered = known.repartition("user_id").sortWithinPartitions("user_id", "now_ms", "id")
    fixed = [tuple(pair) for pair in limits]
    columns = [*KEYS, "now_ms", "id", "status", "wait", "error", "before", "length", "counts", "ends"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, windows, counts = None, None, {}
        for batch in batches:
            out = []
            for row in batch.astype(object).where(batch.notna(), None).itertuples(index=False):
                if row.user_id != user:
                    user, counts = row.user_id, {}
                    windows = None if row.counts is None else [[int(c), int(e)] for c, e in zip(row.counts, row.ends)]
                before = counts.get(row.chat_id, row.stored or 0)
                status, wait = "saved", None
                if row.odd:
                    status = "not_found"
                elif not row.verified:
                    status = "unverified"
                else:
                    windows = lim.check(windows, fixed, int(row.now_ms))
                    wait = lim.wait_seconds(windows, fixed, int(row.now_ms))
                    if wait is not None:
                        status = "limited"
                    elif row.error is not None:
                        status = "invalid"
                    else:
                        counts[row.chat_id] = row.length
                        for window in windows:
                            window[0] += max(0, int(row.length) - int(before))
                error = row.error if status == "invalid" else None
                now = [[w[k] for w in windows] for k in (0, 1)] if status not in ("not_found", "unverified") else [None, None]
                out.append((row.user_id, row.chat_id, row.now_ms, row.id, status, wait, error, before, row.length, *now))
            kinds = {c: "Int64" for c in ("user_id", "wait", "before", "length")}
            yield pd.DataFrame(out, columns=columns).astype(kinds)

    return ordered.mapInPandas(fold, DECISIONS)


def saved_state(saves: DataFrame, decisions: DataFrame, heads: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(HEADS, MESSAGES) of the chats that the accepted saves touch, after them.

    The message at a place is that of the last save that wrote it: one that met fewer messages than that and has more. What none
    wrote stays as it was stored, up to the length of the last save.
    """
    order = ["now_ms", "id"]
    accepted = decisions.where("status = 'saved'")
    chats = val.valid_chats(saves).select(*KEYS, *order, "title", "updated_at", "messages", "history", "summary")
    written = materialise(chats.join(accepted.select(*KEYS, *order, "before", "length"), [*KEYS, *order]), "written")
    place = F.struct(*order)
    clamped = ch.clamp_updated_at(F.col("updated_at"), F.col("now_ms")).alias("updated_at")
    last = written.groupBy(*KEYS).agg(F.max_by(F.struct("title", clamped, "history", "summary", F.col("length").alias("message_count")), place).alias("h"))
    new_heads = last.select(*KEYS, "h.*")
    each = written.select(*KEYS, *order, "before", F.posexplode("messages").alias("turn", "message")).where(F.col("turn") >= F.col("before"))
    latest = each.groupBy(*KEYS, F.col("turn").cast("long").alias("turn")).agg(F.max_by("message", place).alias("message"))
    lengths = new_heads.select(*KEYS, "message_count")
    new = latest.join(lengths, KEYS).where(F.col("turn") < F.col("message_count")).drop("message_count")
    kept = messages.join(lengths, KEYS).where(F.col("turn") < F.col("message_count")).drop("message_count")
    kept = kept.join(new.select(*KEYS, "turn"), [*KEYS, "turn"], "left_anti")
    return new_heads, kept.unionByName(new)


class Store:
    """Tables in buckets of users, changed by batches of which each takes effect once and whole.

    A batch is staged first: the buckets that it changes, as they will be, in a folder of its own. Then its marker is written; from then
    on it counts. Then the staged buckets replace those of the tables, by dynamic partition overwrite, which can be done
    again at any time. A batch that stopped before its marker leaves no trace and runs anew; one that stopped after it is finished by ``recover``.
    """

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, str], result: str):
        self.spark, self.folder, self.tables, self.result = spark, folder.rstrip("/"), tables, result

    def bucket(self):
        return F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)).cast("int").alias("bucket")

    def read(self, name: str) -> DataFrame:
        schema = self.tables[name]
        if not path_exists(self.spark, f"{self.folder}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.folder}/{name}").drop("bucket")

    def load(self, name: str, rows: DataFrame) -> None:
        """Rows to begin with."""
        rows.select("*", self.bucket()).write.partitionBy("bucket").parquet(f"{self.folder}/{name}")

    def staged(self, batch: int) -> str:
        return f"{self.folder}/staged/{batch}"

    def marked(self, batch: int) -> bool:
        return path_exists(self.spark, f"{self.staged(batch)}/marker/_SUCCESS")

    def stage(self, batch: int, changed: dict[str, tuple[DataFrame, list[str]]], result: DataFrame) -> None:
        """Write the buckets as they will be. ``changed``: rows that replace all stored ones with the same keys."""
        touched = result.select(self.bucket()).distinct()
        result.write.mode("overwrite").parquet(f"{self.staged(batch)}/result")
        for name, (rows, keys) in changed.items():
            old = self.read(name).select("*", self.bucket()).join(F.broadcast(touched), "bucket", "left_semi").drop("bucket")
            whole = old.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)
            whole.select("*", self.bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.staged(batch)}/{name}")

    def mark(self, batch: int) -> None:
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.staged(batch)}/marker")

    def apply(self, batch: int) -> None:
        for name, schema in self.tables.items():
            rows = self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.staged(batch)}/{name}")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.folder}/{name}")
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.staged(batch)}/applied")

    def recover(self, batch: int) -> DataFrame | None:
        """Finish a batch that is marked; what it decided. None if it has to run."""
        if not self.marked(batch):
            return None
        if not path_exists(self.spark, f"{self.staged(batch)}/applied/_SUCCESS"):
            self.apply(batch)
        return self.spark.read.schema(self.result).parquet(f"{self.staged(batch)}/result")


def chat_store(spark: SparkSession, folder: str) -> Store:
    return Store(spark, folder, {"heads": HEADS, "messages": MESSAGES, "windows": WINDOWS}, DECISIONS)


def save_chats(store: Store, saves: DataFrame, batch: int, limits: lim.Limits = lim.limits_of("save")) -> DataFrame:
    """Save a batch of chats; DECISIONS of each save. Batches are run one after another; one that ran before only tells what it did."""
    done = store.recover(batch)
    if done is not None:
        return done
    heads, messages = store.read("heads"), store.read("messages")
    decisions = materialise(decide(saves, heads, store.read("windows"), limits), "decisions")
    new_heads, new_messages = saved_state(saves, decisions, heads, messages)
    last = F.max_by(F.struct("counts", "ends"), F.struct("now_ms", "id")).alias("w")
    windows = decisions.where("counts IS NOT NULL").groupBy("user_id").agg(last).select("user_id", "w.*")
    # A chat's messages are replaced whole, so those past its new end go.
    changed = {"heads": (new_heads, KEYS), "messages": (materialise(new_messages, "messages"), KEYS), "windows": (windows, ["user_id"])}
    store.stage(batch, changed, decisions)
    store.mark(batch)
    store.apply(batch)
    return store.recover(batch)


FEEDBACK = (
    "user_id long, feedback_id string, updated_at long, question string, answer string, rating string,"
    " sources array<struct<id: string, cited: boolean, rating: string>>, reasons array<string>, comment string"
)
RATED = "user_id long, feedback_id string, now_ms long, id long, status string, wait long, error string"


def feedback_store(spark: SparkSession, folder: str) -> Store:
    return Store(spark, folder, {"feedback": FEEDBACK}, RATED)


def decide_feedback(sent: DataFrame, limits: lim.Limits) -> DataFrame:
    """RATED of feedback (user_id, feedback_id, now_ms, id, verified, body). Each counts once, also one with an invalid body."""
    odd = ~F.coalesce(ch.valid_id(F.col("feedback_id")), F.lit(False))
    verified = F.coalesce("verified", F.lit(False))
    judged = val.validate_feedback(sent).select("user_id", "feedback_id", "now_ms", "id", odd.alias("odd"), verified.alias("verified"), "error")
    judged = materialise(judged, "feedback")
    counted = judged.where(~F.col("odd") & F.col("verified"))
    log = counted.select(F.col("user_id").alias("client"), "now_ms", "id", F.lit(1).cast("long").alias("amount"))
    taken = lim.rate_limit(log, limits).select(F.col("client").alias("user_id"), "now_ms", "id", "passed", "wait")
    known = judged.join(taken, ["user_id", "now_ms", "id"], "left")
    status = (
        F.when(F.col("odd"), "not_found")
        .when(~F.col("verified"), "unverified")
        .when(~F.col("passed"), "limited")
        .when(F.col("error").isNotNull(), "invalid")
        .otherwise("saved")
    )
    told = known.withColumn("status", status)
    return told.select("user_id", "feedback_id", "now_ms", "id", "status", "wait", F.when(F.col("status") == "invalid", F.col("error")).alias("error"))


def save_feedback(store: Store, sent: DataFrame, batch: int, limits: lim.Limits = lim.limits_of("feedback")) -> DataFrame:
    """Save a batch of feedback, one row for each answer, the last one sent; RATED of each."""
    done = store.recover(batch)
    if done is not None:
        return done
    decisions = materialise(decide_feedback(sent, limits), "decisions")
    keys, order = ["user_id", "feedback_id"], ["now_ms", "id"]
    fine = val.valid_feedback(sent).join(decisions.where("status = 'saved'").select(*keys, *order), [*keys, *order])
    kept = F.struct(F.col("now_ms").alias("updated_at"), "question", "answer", "rating", "sources", "reasons", "comment")
    rows = materialise(fine.groupBy(*keys).agg(F.max_by(kept, F.struct(*order)).alias("f")).select(*keys, "f.*"), "kept")
    store.stage(batch, {"feedback": (rows, keys)}, decisions)
    store.mark(batch)
    store.apply(batch)
    return store.recover(batch)
