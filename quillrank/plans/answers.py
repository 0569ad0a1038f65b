"""From requests to prompts: search text, prior rankings, sources and the packed context."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.functions import fixed_values as fixed
from quillrank.functions import prompts
from quillrank.functions.paths import remedy_name
from quillrank.operators import clinical as cl
from quillrank.operators import history as hist
from quillrank.operators import replies as rep
from quillrank.operators import repertory
from quillrank.operators.ordered import rank_in_group
from quillrank.plans.repertorise import leading_remedies, repertorise
from quillrank.plans.retrieval import best_keys, number_sources, with_payloads
from quillrank.sources.passages import oversize_queries
from quillrank.sources.shared import materialise


@dataclass
class Retrieval:
    """What answers are generated from.

    ``sources`` (query_id, number, source columns); ``repertory`` and ``clinical`` (query_id,
    leader_ord, remedy_name, matched_ord, text, number).
    """

    sources: DataFrame
    repertory: DataFrame
    clinical: DataFrame


def gated_prior(ranking: DataFrame, gate: DataFrame, key: str = "case_id") -> DataFrame:
    """A ranking of remedies as a prior (key, subject, place), of decisive cases only."""
    kept = gate.filter("decisive").select(key)
    return ranking.join(kept, key).select(
        key, F.concat(F.lit("remedy:"), "remedy_id").alias("subject"), F.col("rank").alias("place")
    )


def confirmed_or_read(requests: DataFrame, replies: DataFrame, column: str, parse: Callable) -> DataFrame:
    """(conv_id, ord, item): a request's own list when it is set, even if empty, else the reply's.

    A reply with an ``error`` gives nothing, so its case has no prior ranking.
    """
    given = requests.filter(F.col(column).isNotNull()).select(
        "conv_id", F.posexplode(column).alias("position", "item")
    ).select("conv_id", F.col("position").cast("long").alias("ord"), "item")
    asked = requests.filter(F.col(column).isNull()).select("conv_id")
    usable = replies.filter(F.col("error").isNull()).join(asked, "conv_id", "left_semi")
    read = parse(usable, "conv_id").select("conv_id", (F.col("ord") - 1).alias("ord"), "item")
    return given.unionByName(read)


def searched_texts(requests: DataFrame, history: DataFrame) -> DataFrame:
    """(conv_id, text): what the books are searched by."""
    found = hist.search_query(history, requests, "conv_id").join(requests.drop("message", "summary"), "conv_id")
    text = hist.searched_text(F.col("query"), F.col("symptoms"), F.col("diseases"))
    return found.select("conv_id", text.alias("text"))


def retrieve(
    queries: DataFrame,
    symptoms: DataFrame,
    diseases: DataFrame,
    passages: DataFrame,
    rubrics: DataFrame,
    books: DataFrame,
    terms: DataFrame,
    limit: int = fixed.SOURCE_LIMIT,
    texts: DataFrame | None = None,
) -> Retrieval:
    """Sources and leading remedies of every query.

    ``queries`` (query_id, text, embedding); ``symptoms`` (case_id, symptom_ord, symptom, embedding)
    and ``diseases`` (case_id, disease) of the cases, whose ids are the queries'. Cases that a
    ranking does not tell apart have no rows in it, and so neither a prior nor leaders. ``texts`` as in ``retrieval.all_rankings``.
    """
    run = repertorise(symptoms, rubrics)
    decisive = materialise(run.decisive, "decisive")
    ranked = rank_in_group(run.covered, ["case_id"], repertory.RANKING, [F.col("remedy_id").asc()])

    listed = materialise(cl.case_terms(cl.matched_terms(diseases, terms), terms), "case-terms")
    scored = materialise(cl.scores(listed), "clinical-scores")
    popular = cl.popularity(terms)
    clinical_gate = cl.decisive_match(scored)

    priors = gated_prior(ranked, decisive).withColumn("prior_ord", F.lit(0)).unionByName(
        gated_prior(cl.ranking(scored, popular), clinical_gate).withColumn("prior_ord", F.lit(1))
    )
    found = best_keys(queries, passages, limit, priors.withColumnRenamed("case_id", "query_id"), texts)

    first = found.groupBy("query_id").agg((F.count(F.lit(1)) + 1).alias("first_source"))
    run.covered = run.covered.join(decisive.filter("decisive").select("case_id"), "case_id", "left_semi")
    remedies, cited = leading_remedies(run, rubrics, books, first.withColumnRenamed("query_id", "case_id"))
    sources = numbered_sources(found, cited, passages if texts is None else texts)
    named = remedies.join(symptoms.select("case_id", "symptom_ord", F.col("symptom").alias("text")), ["case_id", "symptom_ord"])
    repertory_rows = named.select(
        F.col("case_id").alias("query_id"), "leader_ord", "remedy_name", F.col("symptom_ord").alias("matched_ord"), "text", "number"
    )
    leaders = cl.first_remedies(scored.join(clinical_gate.filter("decisive").select("case_id"), "case_id", "left_semi"), popular)
    clinical_rows = cl.remedy_terms(leaders, listed).select(
        F.col("case_id").alias("query_id"),
        F.col("rank").alias("leader_ord"),
        remedy_name(F.col("remedy_id")).alias("remedy_name"),
        F.struct("place", "term").alias("matched_ord"),
        F.col("term").alias("text"),
        F.lit(None).cast("long").alias("number"),
    )
    return Retrieval(sources, repertory_rows, clinical_rows)


def numbered_sources(found: DataFrame, cited: DataFrame, passages: DataFrame) -> DataFrame:
    """The found passages and then the cited rubrics as sources. They are numbered by their keys; texts are joined to numbers, so that none is shuffled to be numbered."""
    none = F.lit(None)
    rubric_keys = cited.select(F.col("case_id").alias("query_id"), F.col("cited").alias("rank"), "book_id", F.col("rubric_id").cast("string").alias("rubric"))
    numbered = materialise(
        number_sources(
            found.select("query_id", "rank", "book_id", "id", "score", none.cast("string").alias("rubric")),
            rubric_keys.select("query_id", "rank", "book_id", none.cast(found.schema["id"].dataType).alias("id"), F.lit(0.0).alias("score"), "rubric"),
            "query_id",
        ),
        "numbered-sources",
    )
    columns = ["query_id", "rank", "number"]
    rubrics = cited.select(
        F.col("case_id").alias("query_id"),
        "book_id",
        F.col("rubric_id").cast("string").alias("rubric"),
        "book_title",
        "author",
        F.lit(None).cast("string").alias("remedy_name"),
        "section_title",
        F.array().cast("array<bigint>").alias("passage_indexes"),
        "text",
    )
    told = numbered.where("rubric IS NOT NULL").drop("id").join(rubrics, ["query_id", "book_id", "rubric"]).withColumnRenamed("rubric", "chunk_id")
    payload = with_payloads(numbered.where("rubric IS NULL").drop("rubric"), passages, columns)
    return payload.unionByName(told.select(payload.columns))


def compacted(requests: DataFrame, history: DataFrame, generate: Callable, max_prompt: int, max_chars: int, max_turns: int):
    """Nearly full conversations condensed: (summaries, kept turns).

    All but the latest exchange, with any earlier summary, go to the model; a reply with an error
    leaves its conversation as it was.
    """
    full = hist.context_chars(history, "conv_id", requests).filter(
        hist.should_compact(F.col("chars"), F.col("turns"), max_chars, max_turns)
    )
    chosen = requests.join(full.select("conv_id"), "conv_id", "left_semi").select("conv_id", "summary")
    turns = hist.compact_split(history.join(chosen.select("conv_id"), "conv_id", "left_semi"), "conv_id")
    older = prompts.conversation_text(turns.filter(~F.col("kept")), "conv_id", chosen)
    asked = older.select("conv_id", prompts.compaction_prompt(F.col("conversation"), max_prompt).alias("text"))
    replies = materialise(rep.model_replies(asked, "conv_id", generate, wrap=None), "summaries")
    summaries = replies.filter(F.col("error").isNull()).select(
        "conv_id", prompts.bounded_summary(F.col("reply")).alias("summary")
    )
    kept = turns.filter("kept").join(summaries.select("conv_id"), "conv_id", "left_semi")
    return summaries, kept.select("conv_id", "turn", "role", "text")


def with_compacted(requests: DataFrame, history: DataFrame, summaries: DataFrame, kept: DataFrame):
    """Requests and history with the condensed conversations in place of their own."""
    short = summaries.withColumnRenamed("summary", "_short")
    asked = requests.join(short, "conv_id", "left").withColumn("summary", F.coalesce("_short", "summary")).drop("_short")
    rest = history.join(summaries.select("conv_id"), "conv_id", "left_anti")
    return asked, rest.unionByName(kept)


def build_prompts(
    retrieval: Retrieval, requests: DataFrame, history: DataFrame, max_chars: int = fixed.MAX_PROMPT_CHARS
) -> DataFrame:
    """(conv_id, status, text) of every request.

    ``prompt``: the prompt for the model. ``answered``: no source was found, so the fixed answer
    stands. ``rejected``: a source's text is too long, so no model is paid for.
    """
    sources = materialise(retrieval.sources.withColumnRenamed("query_id", "conv_id"), "sources")
    checked = oversize_queries(sources.withColumnRenamed("conv_id", "query_id"), fixed.MAX_CITATION_CHARS).select(
        F.col("query_id").alias("conv_id"), "rejected"
    )
    blocks = prompts.ranking_block(retrieval.repertory, "query_id", "repertory_ranking", "repertory_block").join(
        prompts.ranking_block(retrieval.clinical, "query_id", "clinical_ranking", "clinical_block"), "query_id", "full"
    )
    conversation = prompts.conversation_text(history, "conv_id", requests.select("conv_id", "summary"))
    asked = (
        requests.join(conversation, "conv_id")
        .join(blocks.withColumnRenamed("query_id", "conv_id"), "conv_id", "left")
        .join(checked, "conv_id", "left")
        .withColumn("confirmed", prompts.confirmed_text(F.col("symptoms"), F.col("diseases")))
        .withColumn("rankings", prompts.rankings_text(F.col("repertory_block"), F.col("clinical_block")))
        .withColumn(
            "status",
            F.when(F.col("rejected").isNull(), F.lit("answered")).when(F.col("rejected"), F.lit("rejected")).otherwise(F.lit("prompt")),
        )
    )
    ready = asked.filter(F.col("status") == "prompt").select("conv_id", "conversation", "message", "confirmed", "rankings")
    parts = sources.select("conv_id", "number", prompts.excerpt_part().alias("part"))
    written = prompts.generation_prompt(ready, parts, "conv_id", max_chars)
    return (
        asked.select("conv_id", "status")
        .join(written, "conv_id", "left")
        .select(
            "conv_id",
            "status",
            F.when(F.col("status") == "answered", F.lit(fixed.NO_SOURCES_ANSWER)).otherwise(F.col("prompt")).alias("text"),
        )
    )
