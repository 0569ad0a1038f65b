"""Texts sent to a model, under a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions import fixed_values as fixed
from quillrank.functions.words import cut, strip


def conversation_text(history: DataFrame, key: str, headers: DataFrame) -> DataFrame:
    """A summary, if there is one, and the turns, oldest first, as tagged lines: (key, conversation).

    ``headers`` has (key, summary) and decides which keys are returned. All turns are given: how long
    a history may be is for ``validate_requests`` to say, before it comes here.
    """
    line = F.format_string("<%s>%s</%s>", "role", "text", "role")
    lines = history.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("_lines"))
    turns = F.transform(F.coalesce("_lines", F.array().cast("array<struct<turn:bigint,line:string>>")), lambda t: t["line"])
    first = F.when(
        F.coalesce(F.col("summary"), F.lit("")) != "", F.array(F.format_string("<summary>%s</summary>", "summary"))
    ).otherwise(F.array().cast("array<string>"))
    joined = F.array_join(F.concat(first, turns), "\n")
    return headers.join(lines, key, "left").select(key, joined.alias("conversation"))


def confirmed_text(symptoms: Column, diseases: Column) -> Column:
    """What a user confirmed. No diseases at all is said; an unset list says nothing."""

    def block(values: Column, many: str, one: str) -> Column:
        head, tail = fixed.CONFIRMED_BLOCK.format(many=many, one=one, lines="\0").split("\0")
        return F.concat(F.lit(head), F.array_join(values, "\n"), F.lit(tail))

    about = F.when(F.size(symptoms) > 0, block(symptoms, "symptoms", "symptom")).otherwise(F.lit(""))
    named = (
        F.when(diseases.isNull(), F.lit(""))
        .when(F.size(diseases) == 0, F.lit(fixed.CONFIRMED_NONE))
        .otherwise(block(diseases, "diseases", "disease"))
    )
    return F.concat(about, named)


def ranking_block(leaders: DataFrame, key: str, tag: str, out: str) -> DataFrame:
    """(key, out): leading remedies with what they matched, as one tagged block.

    ``leaders`` has (key, leader_ord, remedy_name, matched_ord, text, number). It holds the few
    leading remedies and at most the case's symptoms or terms for each.
    """
    marked = F.when(F.col("number").isNull(), F.col("text")).otherwise(F.format_string("%s [%d]", "text", "number"))
    each = leaders.groupBy(key, "leader_ord", "remedy_name").agg(
        F.array_sort(F.collect_list(F.struct("matched_ord", marked.alias("m")))).alias("m")
    )
    line = F.format_string(
        "%d. %s: %s", "leader_ord", "remedy_name", F.array_join(F.transform("m", lambda x: x["m"]), "; ")
    )
    whole = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("leader_ord", line.alias("l")))).alias("l"))
    lines = F.array_join(F.transform("l", lambda x: x["l"]), "\n")
    return whole.select(key, F.concat(F.lit(f"<{tag}>\n"), lines, F.lit(f"\n</{tag}>\n")).alias(out))


def rankings_text(repertory_block: Column, clinical_block: Column) -> Column:
    blocks = F.concat(F.coalesce(repertory_block, F.lit("")), F.coalesce(clinical_block, F.lit("")))
    return F.when(blocks == "", F.lit("")).otherwise(F.concat(F.lit(fixed.RANKINGS_HEAD), blocks, F.lit("\n")))


def prompt_frame(requests: DataFrame, max_chars: int) -> DataFrame:
    """``prefix`` of the prompt and the characters ``available`` for excerpts.

    ``requests`` has conversation, message, confirmed and rankings. A quarter of the budget is kept
    for evidence; the oldest of the conversation is cut first, then the end of the latest message.
    """
    tail = F.concat(F.lit(fixed.CONVERSATION_TAIL), "confirmed", "rankings", F.lit(fixed.EXCERPTS_HEAD))
    frame = F.lit(len(fixed.CONVERSATION_HEAD) + len(fixed.EXCERPTS_TAIL)) + F.length("_tail")
    zero = F.lit(0)
    return (
        requests.withColumn("_tail", tail)
        .withColumn("_latest", F.concat(F.lit("<latest_user_message>"), "message", F.lit("</latest_user_message>")))
        .withColumn("_frame", frame)
        .withColumn(
            "_room", F.greatest(zero, F.lit(max_chars - max_chars // 4) - F.col("_frame") - F.length("_latest"))
        )
        .withColumn("_past", F.when(F.col("_room") > 0, F.right("conversation", F.col("_room"))).otherwise(F.lit("")))
        .withColumn("_latest_room", F.greatest(zero, F.lit(max_chars) - F.col("_frame") - F.length("_past")))
        .withColumn("_latest", F.left("_latest", F.col("_latest_room")))
        .withColumn(
            "prefix",
            F.concat(
                F.lit(fixed.CONVERSATION_HEAD),
                F.when(F.col("_past") != "", F.concat("_past", F.lit("\n"))).otherwise(F.lit("")),
                "_latest",
                "_tail",
            ),
        )
        .withColumn(
            "available", F.greatest(zero, F.lit(max_chars - len(fixed.EXCERPTS_TAIL)) - F.length("prefix")).cast("long")
        )
        .drop("_tail", "_latest", "_frame", "_room", "_past", "_latest_room")
    )


def excerpt_part() -> Column:
    """One numbered source with its heading, as it stands in a prompt."""
    present = [F.when(F.col(name) != "", F.col(name)) for name in ("book_title", "remedy_name", "section_title")]
    return F.concat(
        F.lit("["), F.col("number").cast("string"), F.lit("] "), F.concat_ws(" — ", *present), F.lit("\n"), "text", F.lit("\n\n")
    )


def pack_excerpts(parts: DataFrame, budgets: DataFrame, key: str) -> DataFrame:
    """Parts in order, cut to the characters left of the key's ``available``; none after a cut.

    ``parts`` has (key, number, part): an answer's sources, of which there are at most the search's
    limit and the cap on rubrics.
    """
    order = Window.partitionBy(key).orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("part")).over(order), F.lit(0))
    left = F.col("available") - F.col("_before")
    return (
        parts.join(budgets, key)
        .withColumn("_before", before)
        .filter(left > 0)
        .select(key, "number", F.left("part", left.cast("int")).alias("part"))
    )


def generation_prompt(requests: DataFrame, parts: DataFrame, key: str, max_chars: int) -> DataFrame:
    """(key, prompt) for every request, with the excerpts that fit."""
    framed = prompt_frame(requests, max_chars)
    packed = pack_excerpts(parts, framed.select(key, "available"), key)
    joined = packed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("number", "part"))).alias("_parts"))
    excerpts = F.array_join(F.transform("_parts", lambda p: p["part"]), "")
    return framed.join(joined, key, "left").select(
        key,
        F.concat(
            "prefix", F.coalesce(excerpts, F.lit(fixed.NO_EXCERPTS)), F.lit(fixed.EXCERPTS_TAIL)
        ).alias("prompt"),
    )


def compaction_prompt(conversation: Column, max_chars: int) -> Column:
    """The prompt to condense a conversation, of which the latest characters are kept."""
    room = max(0, max_chars - len(fixed.CONVERSATION_HEAD) - len(fixed.COMPACTION_TAIL))
    kept = F.right(conversation, F.lit(room)) if room else F.lit("")
    return F.concat(F.lit(fixed.CONVERSATION_HEAD), kept, F.lit(fixed.COMPACTION_TAIL))


def bounded_answer(text: Column, max_chars: int = fixed.MAX_ANSWER_CHARS) -> Column:
    """A finished answer, cut with an ellipsis when it is longer than an answer may be."""
    whole = strip(text)
    return F.when(F.length(whole) > max_chars, F.concat(cut(whole, max_chars), F.lit("…"))).otherwise(whole)


def bounded_summary(text: Column, max_chars: int = fixed.MAX_TURN_CHARS) -> Column:
    """A summary that fits one turn, ellipsis included."""
    whole = strip(text)
    return F.when(F.length(whole) > max_chars, F.concat(cut(whole, max_chars - 1), F.lit("…"))).otherwise(whole)


def title_from(question: Column) -> Column:
    """A question on one line, shortened to a chat's title."""
    line = strip(F.regexp_replace(question, r"(?U)[\s﻿]+", " "))
    limit = fixed.MAX_SHORT_TITLE_CHARS
    return F.when(F.length(line) > limit, F.concat(cut(line, limit - 1), F.lit("…"))).otherwise(line)
