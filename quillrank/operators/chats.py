"""Saved chats and their messages as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions.fixed_values import ID_PATTERN, MAX_LISTED_CHATS, MAX_LOCAL_CHATS
from quillrank.functions.paths import pad_index
from quillrank.functions.prompts import title_from
from quillrank.functions.words import strip
from quillrank.operators import validate as val
from quillrank.operators.ordered import top_k

DAY_MS = 24 * 60 * 60 * 1000


def newest_first() -> list[Column]:
    return [F.col("updated_at").desc(), F.col("chat_id").asc()]


def list_chats(chats: DataFrame, cap: int = MAX_LISTED_CHATS) -> DataFrame:
    """Each user's newest chats."""
    return top_k(chats.select("user_id", "chat_id", "title", "updated_at"), ["user_id"], newest_first(), cap, "place")


def open_chats(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """The messages of chats that exist, with the id that orders them; none of any other chat."""
    return messages.join(chats.select("chat_id"), "chat_id").withColumn("message_doc", pad_index(F.col("turn")))


def save_delta(stored: DataFrame, stored_messages: DataFrame, incoming: DataFrame) -> DataFrame:
    """What saving whole chats writes: (chat_id, turn, action).

    Messages are only appended, so indexes that the stored chat has are left as they are, even when
    their text changed; those past the new end are deleted.
    """
    counts = stored.select("chat_id", "message_count")
    added = (
        incoming.join(counts, "chat_id", "left")
        .filter(F.col("turn") >= F.coalesce("message_count", F.lit(0)))
        .select("chat_id", "turn", F.lit("set").alias("action"))
    )
    lengths = incoming.groupBy("chat_id").agg((F.max("turn") + 1).alias("new_count"))
    removed = (
        stored_messages.join(lengths, "chat_id")
        .filter(F.col("turn") >= F.col("new_count"))
        .select("chat_id", "turn", F.lit("delete").alias("action"))
    )
    return added.unionByName(removed)


def apply_delta(stored_messages: DataFrame, incoming: DataFrame, delta: DataFrame) -> DataFrame:
    """The messages after a save; written by chat or user with dynamic partition overwrite."""
    keys = ["chat_id", "turn"]
    gone = delta.filter(F.col("action") == "delete").select(keys)
    new = incoming.join(delta.filter(F.col("action") == "set").select(keys), keys, "left_semi")
    # A set replaces what may still lie at its place, as when a head counts too few messages.
    replaced = gone.unionByName(new.select(keys))
    return stored_messages.join(replaced, keys, "left_anti").unionByName(new)


def new_messages(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """How many messages each save writes, which is what it counts against the save limit."""
    lengths = incoming.groupBy("chat_id").agg((F.max("turn") + 1).alias("new_count"))
    return lengths.join(stored.select("chat_id", "message_count"), "chat_id", "left").select(
        "chat_id",
        F.greatest(F.lit(0).cast("long"), F.col("new_count") - F.coalesce("message_count", F.lit(0).cast("long"))).alias("written"),
    )


def without_deleted(frame: DataFrame, deleted: DataFrame, key: str = "user_id") -> DataFrame:
    return frame.join(deleted.select(key), key, "left_anti")


def read_archives(archives: DataFrame, whole: bool = False) -> DataFrame:
    """The chats in each archive, a JSON array, newest first; what cannot be read is skipped.

    Values keep their JSON type here, so a number is not taken for a text.
    """
    entries = F.try_variant_get(F.try_parse_json("archive"), "$", "array<variant>")
    each = archives.select("archive_id", F.posexplode(entries).alias("position", "entry"))

    def is_kind(name: str, kinds: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get("entry", f"$.{name}", "variant")).rlike(f"^({kinds})"), F.lit(False))

    shaped = (
        is_kind("id", "STRING")
        & is_kind("title", "STRING")
        & is_kind("updatedAt", "BIGINT|DECIMAL|DOUBLE")
        & is_kind("messages", "ARRAY")
        & is_kind("history", "ARRAY")
    )
    place = Window.partitionBy("archive_id").orderBy(F.col("updated_at").desc(), F.col("position").asc())
    return (
        each.filter(shaped)
        .select(
            "archive_id",
            "position",
            F.try_variant_get("entry", "$.id", "string").alias("chat_id"),
            F.try_variant_get("entry", "$.title", "string").alias("title"),
            F.try_variant_get("entry", "$.updatedAt", "bigint").alias("updated_at"),
            *(["entry"] if whole else []),
        )
        .withColumn("place", F.row_number().over(place).cast("long"))
        .drop("position")
    )


def whole_archives(archives: DataFrame) -> DataFrame:
    """The chats of each archive as typed rows: messages with their sources, history and summary; newest first.

    A field of another kind than it should have is NULL; ``entry`` keeps the chat as it was written, so nothing is lost on the way back.
    """
    listed = read_archives(archives, whole=True)
    entry = F.col("entry")
    history = F.transform(
        val.items(val.field(entry, "history")),
        lambda t: F.struct(val.string(val.field(t, "role")).alias("role"), val.string(val.field(t, "content")).alias("content")),
    )
    return listed.select(
        "archive_id",
        "place",
        "chat_id",
        "title",
        "updated_at",
        val.typed_messages(val.field(entry, "messages")).alias("messages"),
        history.alias("history"),
        val.string(val.field(entry, "summary")).alias("summary"),
        F.to_json("entry").alias("entry"),
    )


def open_conversations(heads: DataFrame, messages: DataFrame) -> DataFrame:
    """What opening chats gives, in long form: (keys, part, place, role, text), parts being message, history and summary.

    ``heads`` (user_id, chat_id, history, summary) are the chats that exist; ``messages`` (user_id, chat_id, turn, role, text).
    """
    keys = ["user_id", "chat_id"]
    said = messages.join(heads.select(*keys), keys).select(*keys, F.lit("message").alias("part"), F.col("turn").alias("place"), "role", "text")
    turns = heads.select(*keys, F.posexplode("history").alias("place", "t"))
    earlier = turns.select(*keys, F.lit("history").alias("part"), F.col("place").cast("long").alias("place"), "t.role", F.col("t.content").alias("text"))
    short = heads.where(F.col("summary").isNotNull()).select(
        *keys, F.lit("summary").alias("part"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("string").alias("role"), F.col("summary").alias("text")
    )
    return said.unionByName(earlier).unionByName(short)


def retain_newest(chats: DataFrame, quota: int, cap: int = MAX_LOCAL_CHATS, saved: Column | None = None) -> DataFrame:
    """The chats of each user that fit the quota of bytes; ``too_large`` if not even one does.

    The chat just saved comes first, whatever its time, and then the newest.
    """
    front = [] if saved is None else [F.coalesce(saved, F.lit(False)).desc()]
    first = top_k(chats, ["user_id"], [*front, *newest_first()], cap, "place")
    running = Window.partitionBy("user_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        first.withColumn("used", F.sum("bytes").over(running))
        .withColumn("too_large", (F.col("place") == 1) & (F.col("used") > quota))
        .filter((F.col("used") <= quota) | F.col("too_large"))
    )


def merge_library(account: DataFrame, local: DataFrame) -> DataFrame:
    """Both libraries after local chats moved into the account: (user_id, chat_id, …, library, failed).

    A local chat replaces the account's of the same id. One that the account rejects (``valid`` is
    false) stays local and counts as failed.
    """
    columns = ["user_id", "chat_id", "title", "updated_at"]
    moved = local.filter("valid").select(*columns, F.lit(1).alias("_order"))
    kept = account.select(*columns, F.lit(0).alias("_order"))
    merged = (
        kept.unionByName(moved)
        .groupBy("user_id", "chat_id")
        .agg(F.max_by(F.struct("title", "updated_at"), "_order").alias("c"))
        .select("user_id", "chat_id", "c.*", F.lit("account").alias("library"), F.lit(False).alias("failed"))
    )
    left = local.filter(~F.col("valid")).select(*columns, F.lit("local").alias("library"), F.lit(True).alias("failed"))
    return merged.unionByName(left)


def valid_id(value: Column) -> Column:
    return value.rlike(ID_PATTERN)


def clamp_updated_at(updated_at: Column, now_ms: Column) -> Column:
    """A clock set in the future must not keep a chat at the top of every list."""
    return F.least(updated_at, now_ms)


def title_matches(title: Column, search: Column) -> Column:
    return F.contains(F.lower(title), F.lower(strip(search)))


def verified_only(rows: DataFrame, users: DataFrame) -> DataFrame:
    return rows.join(users.filter("verified").select("user_id"), "user_id", "left_semi")


def saved_messages(messages: DataFrame) -> DataFrame:
    """Messages without failed ones and the question before each of those.

    A message's successor is found by an anti-join on (chat, place), not by a window over the chat.
    """
    failed = messages.filter(F.col("status") == "error").select("chat_id", (F.col("turn") - 1).alias("turn"))
    fine = messages.filter(F.col("status").isNull() | (F.col("status") != "error"))
    return fine.join(failed, ["chat_id", "turn"], "left_anti")


def rateable_answers(messages: DataFrame) -> DataFrame:
    """Finished answers that directly follow a user's question, with it."""
    answers = messages.filter(
        (F.col("role") == "assistant") & F.col("status").isNull() & (F.coalesce("text", F.lit("")) != "")
    ).select("chat_id", "turn", F.col("text").alias("answer"))
    questions = messages.filter(F.col("role") == "user").select(
        "chat_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question")
    )
    return answers.join(questions, ["chat_id", "turn"])


def midnight_of(now_ms: Column, zone: str = "UTC") -> Column:
    """The last midnight of a zone, in milliseconds."""
    day = F.date_trunc("day", F.from_utc_timestamp(F.timestamp_millis(now_ms), zone))
    return F.unix_millis(F.to_utc_timestamp(day, zone))


def age_groups(listed: DataFrame, now_ms: int, zone: str = "UTC") -> DataFrame:
    """Listed chats with the label of their age and the number of their run of one label.

    Days are 24 hours back from the last midnight of the zone. ``listed`` is bounded by the cap of
    ``list_chats``.
    """
    midnight = midnight_of(F.lit(now_ms), zone)
    label = (
        F.when(F.col("updated_at") >= midnight, F.lit("Today"))
        .when(F.col("updated_at") >= midnight - DAY_MS, F.lit("Yesterday"))
        .when(F.col("updated_at") >= midnight - 7 * DAY_MS, F.lit("Previous 7 days"))
        .otherwise(F.lit("Older"))
    )
    order = Window.partitionBy("user_id").orderBy("place")
    starts = (F.col("label") != F.lag("label").over(order)).cast("long")
    return (
        listed.withColumn("label", label)
        .withColumn("_starts", F.coalesce(starts, F.lit(1).cast("long")))
        .withColumn("run", F.sum("_starts").over(order))
        .drop("_starts")
    )


def chat_titles(messages: DataFrame) -> DataFrame:
    """A chat's title: its first question, shortened; empty without one."""
    first = messages.groupBy("chat_id").agg(
        F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("_first")
    )
    return first.select("chat_id", F.coalesce(title_from(F.col("_first")), F.lit("")).alias("title"))

