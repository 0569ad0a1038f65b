"""Repertorisation: symptoms with vectors to ranked remedies and the rubrics behind them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions.fixed_values import RUBRICS_PER_SYMPTOM
from quillrank.functions.paths import remedy_name
from quillrank.operators import repertory as rep
from quillrank.operators.knn import nearest
from quillrank.sources.passages import listed_remedies
from quillrank.sources.shared import materialise


@dataclass
class Repertorised:
    """The tables of one run: kept matches, their remedies, each remedy's coverage, and the gate."""

    matches: DataFrame
    hits: DataFrame
    covered: DataFrame
    decisive: DataFrame


def symptom_rubrics(symptoms: DataFrame, rubrics: DataFrame, limit: int = RUBRICS_PER_SYMPTOM) -> DataFrame:
    """The ``limit`` rubrics nearest to each symptom in every repertory."""
    return nearest(
        symptoms,
        rubrics.withColumnRenamed("id", "rubric_id"),
        limit,
        ["case_id", "symptom_ord"],
        ["repertory_ord", "book_id", "rubric_id"],
        within=["repertory_ord", "book_id"],
        ties=["rubric_id"],
    )


def combined(found: DataFrame) -> DataFrame:
    """The repertories' results one after another: ``rubric_ord`` from 1 for each symptom.

    A symptom has at most ``limit`` rows for each repertory.
    """
    order = Window.partitionBy("case_id", "symptom_ord").orderBy("repertory_ord", "pos")
    return found.withColumn("rubric_ord", F.row_number().over(order).cast("long")).select(
        "case_id", "symptom_ord", "rubric_ord", "book_id", "rubric_id"
    )


def remedy_rows(matches: DataFrame, rubrics: DataFrame) -> DataFrame:
    """One row for each remedy of a matched rubric."""
    matched = matches.select("book_id", F.col("rubric_id").alias("id")).distinct()
    # Only records that were matched are looked at; one that is not whole is an error.
    listed = listed_remedies(rubrics.join(matched, ["book_id", "id"], "left_semi"))
    return matches.join(listed, ["book_id", "rubric_id"])


def repertorise(symptoms: DataFrame, rubrics: DataFrame) -> Repertorised:
    matches = materialise(rep.distinct_matches(combined(symptom_rubrics(symptoms, rubrics))), "matches")
    hits = remedy_rows(matches, rubrics)
    covered = materialise(rep.coverage(hits), "coverage")
    return Repertorised(matches, hits, covered, rep.decisive(covered, rep.symptom_counts(matches)))


def first_listed(hits: DataFrame) -> DataFrame:
    """A remedy's first listing in a rubric, which is the one that is cited."""
    keys = [c for c in hits.columns if c not in ("listed_ord", "grade")]
    return hits.groupBy(*keys).agg(F.min_by("grade", "listed_ord").alias("grade"))


def leading_remedies(run: Repertorised, rubrics: DataFrame, books: DataFrame, first_source: DataFrame | int = 1):
    """The leaders' matched symptoms, and the cited rubrics as sources.

    Returns (remedies, sources): (case_id, leader_ord, remedy_name, symptom_ord, number) and
    (case_id, cited, number, rubric columns, text).
    """
    leaders = materialise(rep.standing_out(run.covered), "leaders")
    best = materialise(rep.best_rubrics(leaders, first_listed(run.hits)), "best-rubrics")
    numbered = materialise(rep.number_rubrics(best, first_source), "numbered")
    remedies = rep.matched_symptoms(best, numbered).select(
        "case_id", "leader_ord", remedy_name(F.col("remedy_id")).alias("remedy_name"), "symptom_ord", "number"
    )
    listed = numbered.join(
        rubrics.select("book_id", F.col("id").alias("rubric_id"), F.posexplode("remedies").alias("listed_ord", "r")),
        ["book_id", "rubric_id"],
    ).select("case_id", "book_id", "rubric_id", "listed_ord", "r.remedy_id", "r.grade")
    placed = listed.join(leaders.select("case_id", "remedy_id", "leader_ord"), ["case_id", "remedy_id"], "left")
    texts = rep.rubric_listing(placed, ["case_id", "book_id", "rubric_id"])
    titles = rubrics.select("book_id", F.col("id").alias("rubric_id"), rep.rubric_title(F.col("text")).alias("section_title"))
    sources = rep.with_book(
        numbered.join(texts, ["case_id", "book_id", "rubric_id"]).join(titles, ["book_id", "rubric_id"]), books
    )
    return remedies, sources
