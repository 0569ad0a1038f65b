"""Ranking remedies by graded coverage of a case's symptoms.

Tables: ``matches`` (case_id, symptom_ord, rubric_ord, book_id, rubric_id) and ``hits`` with one row
per remedy of a matched rubric (… remedy_id, grade).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.functions.fixed_values import (
    INDECISIVE_TIES,
    LEADING_REMEDIES,
    MAX_RUBRIC_REMEDIES,
    MAX_RUBRIC_SOURCES,
    MAX_RUBRIC_TITLE_CHARS,
)
from quillrank.functions.paths import remedy_name
from quillrank.operators.ordered import rank_in_group, top_k

RANKING = [("symptoms", True), ("grades", True)]


def distinct_matches(matches: DataFrame) -> DataFrame:
    """Each rubric only under the first symptom that matched it.

    A minimum per (case, rubric) is combined before the shuffle; symptoms left without rubrics have
    no rows any more.
    """
    carried = [c for c in matches.columns if c not in ("case_id", "book_id", "rubric_id", "symptom_ord", "rubric_ord")]
    first = F.min(F.struct("symptom_ord", "rubric_ord", *carried)).alias("m")
    return matches.groupBy("case_id", "book_id", "rubric_id").agg(first).select(
        "case_id", "book_id", "rubric_id", "m.*"
    )


def best_grades(hits: DataFrame) -> DataFrame:
    """A remedy's best grade among one symptom's rubrics."""
    return hits.groupBy("case_id", "symptom_ord", "remedy_id").agg(F.max("grade").alias("grade"))


def coverage(hits: DataFrame) -> DataFrame:
    """How many symptoms of the case a remedy covers, and the sum of its best grades."""
    return best_grades(hits).groupBy("case_id", "remedy_id").agg(
        F.count(F.lit(1)).alias("symptoms"), F.sum("grade").alias("grades")
    )


def rank_remedies(hits: DataFrame) -> DataFrame:
    """Every remedy of a case with its rank: by symptoms, then grades, then id."""
    return rank_in_group(coverage(hits), ["case_id"], RANKING, [F.col("remedy_id").asc()])


def first_remedies(covered: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of the ranking, without ranking the others."""
    order = [F.col("symptoms").desc(), F.col("grades").desc(), F.col("remedy_id").asc()]
    return top_k(covered, ["case_id"], order, k)


def decisive(covered: DataFrame, symptom_counts: DataFrame) -> DataFrame:
    """Per case, whether the ranking tells remedies apart.

    It does when the lead covers more than one symptom and at least half, or when few remedies cover
    as many. ``symptom_counts`` (case_id, case_symptoms) counts symptoms that kept a rubric; a case
    without remedies is not decisive.
    """
    levels = covered.groupBy("case_id", "symptoms").agg(F.count(F.lit(1)).alias("tied"))
    lead = levels.groupBy("case_id").agg(
        F.max("symptoms").alias("lead"), F.max_by("tied", "symptoms").alias("tied")
    )
    clear = (F.col("lead") > 1) & (F.col("lead") * 2 >= F.col("case_symptoms"))
    return (
        symptom_counts.join(lead, "case_id", "left")
        .withColumn("lead", F.coalesce("lead", F.lit(0)))
        .withColumn("tied", F.coalesce("tied", F.lit(0)))
        .withColumn("decisive", (F.col("lead") > 0) & (clear | (F.col("tied") < INDECISIVE_TIES)))
    )


def symptom_counts(matches: DataFrame) -> DataFrame:
    """Symptoms of each case that have a rubric, counted on the few distinct (case, symptom)."""
    return (
        matches.select("case_id", "symptom_ord").distinct().groupBy("case_id").agg(F.count(F.lit(1)).alias("case_symptoms"))
    )


def standing_out(covered: DataFrame, limit: int = LEADING_REMEDIES) -> DataFrame:
    """The first ``limit`` remedies without those that tie with the next one; ``leader_ord`` from 1."""
    first = first_remedies(covered, limit + 1)
    score = F.struct("symptoms", "grades")
    following = first.filter(F.col("rank") == limit + 1).select("case_id", score.alias("_next"))
    return (
        first.filter(F.col("rank") <= limit)
        .join(following, "case_id", "left")
        .filter(~F.col("_next").eqNullSafe(score))
        .select("case_id", "remedy_id", "symptoms", "grades", F.col("rank").cast("long").alias("leader_ord"))
    )


def best_rubrics(leaders: DataFrame, hits: DataFrame) -> DataFrame:
    """For each symptom and leader, the first rubric with the highest grade above 0."""
    carried = [c for c in ("book_id", "rubric_id", "symptom") if c in hits.columns]
    pick = F.struct("grade", (-F.col("rubric_ord")).alias("early"))
    return (
        hits.filter(F.col("grade") > 0)
        .join(leaders.select("case_id", "remedy_id", "leader_ord"), ["case_id", "remedy_id"])
        .groupBy("case_id", "symptom_ord", "leader_ord", "remedy_id")
        .agg(F.max_by(F.struct("rubric_ord", *carried), pick).alias("r"), F.max("grade").alias("grade"))
        .select("case_id", "symptom_ord", "leader_ord", "remedy_id", "grade", "r.*")
    )


def number_rubrics(best: DataFrame, first_source: DataFrame | int, cap: int = MAX_RUBRIC_SOURCES) -> DataFrame:
    """Cited rubrics numbered by first appearance, at most ``cap`` of a case.

    ``first_source`` is the number of the first, the same for all or one per case
    (case_id, first_source).
    """
    appears = best.groupBy("case_id", "book_id", "rubric_id").agg(
        F.min(F.struct("symptom_ord", "leader_ord")).alias("seen")
    )
    cited = top_k(appears, ["case_id"], [F.col("seen").asc()], cap, "cited")
    if isinstance(first_source, int):
        start = cited.withColumn("first_source", F.lit(first_source).cast("long"))
    else:
        start = cited.join(first_source, "case_id", "left").withColumn(
            "first_source", F.coalesce("first_source", F.lit(1).cast("long"))
        )
    return start.withColumn("number", F.col("first_source") + F.col("cited") - 1).select(
        "case_id", "book_id", "rubric_id", F.col("cited").cast("long").alias("cited"), "number"
    )


def matched_symptoms(best: DataFrame, numbered: DataFrame) -> DataFrame:
    """Each leader's covered symptoms with the number of the rubric, or none past the cap."""
    return best.join(numbered, ["case_id", "book_id", "rubric_id"], "left")


def rubric_listing(listed: DataFrame, keys: list[str], shown: int = MAX_RUBRIC_REMEDIES) -> DataFrame:
    """A cited rubric's text: leaders in their order, then by grade, then as listed.

    ``listed`` has one row per remedy of a cited rubric: keys, listed_ord, remedy_id, grade and
    leader_ord (NULL unless it leads). At most ``shown`` remedies are named, the rest are counted.
    """
    order = [F.coalesce("leader_ord", F.lit(2**31)).asc(), F.col("grade").desc(), F.col("listed_ord").asc()]
    first = top_k(listed, keys, order, shown, "_place")
    label = F.format_string("%s (%d)", remedy_name(F.col("remedy_id")), F.col("grade"))
    named = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_place", label.alias("label")))).alias("l"))
    totals = listed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    more = F.col("_all") - F.size("l")
    return named.join(totals, keys).select(
        *keys,
        F.concat(
            F.lit("Remedies and their grades: "),
            F.array_join(F.transform("l", lambda x: x["label"]), ", "),
            F.when(more > 0, F.format_string(", and %d more", more)).otherwise(F.lit("")),
        ).alias("text"),
    )


def with_book(rubrics: DataFrame, books: DataFrame) -> DataFrame:
    """The repertory's title and author; an unknown one is titled by its id."""
    return rubrics.join(books, "book_id", "left").withColumn("book_title", F.coalesce("book_title", "book_id"))


def rubric_title(text) -> object:
    return F.left(text, F.lit(MAX_RUBRIC_TITLE_CHARS))
