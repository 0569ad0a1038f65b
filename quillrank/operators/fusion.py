"""Reciprocal-rank fusion of rankings, and regrouping by the support of several collections.

A ranking row is (query_id, ranking_ord, pos, book_id, id, subject): the dense ranking has
``ranking_ord`` 0 and a collection's sparse ranking its place in the catalog plus one, so the order
(ranking_ord, pos) is the order in which candidates first appear. After the rankings are cut to
``limit * PREFETCH`` rows each, a query has at most that many times (collections + 1) candidates;
every step here works on one exchange by query of that bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions.fixed_values import DIFFERENTIAL_REMEDIES, DOMINANT_SHARE, PRIOR_K, RRF_K
from quillrank.operators.ordered import fixed_point, top_k

# Sums of several terms are kept in whole units of this digit.
DIGITS = 12


def union_rankings(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    columns = ["query_id", "ranking_ord", "pos", "book_id", "book_ord", "id", "subject", "score"]
    first = dense.withColumn("ranking_ord", F.lit(0).cast("long"))
    rest = sparse.withColumn("ranking_ord", (F.col("book_ord") + F.lit(1)).cast("long"))
    return first.select(columns).unionByName(rest.select(columns))


def fuse(rankings: DataFrame) -> DataFrame:
    """Each candidate's summed reciprocal ranks and where it first appears. Rows are dealt by query here, and stay so in all later steps."""
    return rankings.repartition("query_id").groupBy("query_id", "book_id", "id", "subject").agg(
        F.sum(rank_share(F.col("pos"))).alias("score"),
        F.min(F.struct("ranking_ord", "pos")).alias("first"),
    )


def ranked(fused: DataFrame) -> DataFrame:
    """Fused candidates with their place ``fused_rank``: by score, then by first appearance."""
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("first").asc())
    return fused.withColumn("fused_rank", F.row_number().over(by_score).cast("long"))


def with_dominance(candidates: DataFrame, limit: int) -> DataFrame:
    """Whether one subject holds at least the dominant share of the requested places."""
    subject = Window.partitionBy("query_id", "subject")
    query = Window.partitionBy("query_id")
    held = F.sum((F.col("fused_rank") <= limit).cast("long")).over(subject)
    return (
        candidates.withColumn("_held", held)
        .withColumn("most_held", F.max("_held").over(query))
        .withColumn("dominated", F.col("most_held") >= F.lit(limit * DOMINANT_SHARE))
        .drop("_held")
    )


def with_support(candidates: DataFrame) -> DataFrame:
    """A subject's support: the sum of its best score in each collection, and its place by that.

    ``support`` is in whole units of the twelfth digit.
    """
    subject = Window.partitionBy("query_id", "subject")
    in_book = Window.partitionBy("query_id", "subject", "book_id").orderBy("fused_rank")
    places = Window.partitionBy("query_id").orderBy(F.col("support").desc(), F.col("first_rank").asc())
    return (
        candidates.withColumn("_best", F.row_number().over(in_book) == 1)
        .withColumn("support", F.sum(F.when(F.col("_best"), fixed_point(F.col("score"), DIGITS))).over(subject))
        .withColumn("first_rank", F.min("fused_rank").over(subject))
        .withColumn("support_rank", F.dense_rank().over(places).cast("long"))
        .drop("_best")
    )


def with_priors(candidates: DataFrame, priors: DataFrame | None, k: int = PRIOR_K) -> DataFrame:
    """``place``: the subject's place once its support rank is fused with prior rankings.

    ``priors`` holds (query_id, prior_ord, subject, place). Subjects that only a prior ranks are
    left out. Without priors the places are the support ranks.
    """
    if priors is None:
        return candidates.withColumn("place", F.col("support_rank"))

    def share(place):
        return fixed_point(F.lit(1.0) / (F.lit(k) + place), DIGITS)

    named = priors.where(F.col("subject").isNotNull()).repartition("query_id")
    lift = named.groupBy("query_id", "subject").agg(F.sum(share(F.col("place"))).alias("lift"))
    # By query alone, so that candidates stay where they are: a query has one entry for each subject that a prior ranks.
    lifts = lift.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("subject", "lift"))).alias("_lifts"))
    score = share(F.col("support_rank")) + F.coalesce(F.try_element_at("_lifts", F.col("subject")), F.lit(0).cast("long"))
    places = Window.partitionBy("query_id").orderBy(F.col("prior_score").desc(), F.col("support_rank").asc())
    return (
        candidates.join(lifts, "query_id", "left")
        .withColumn("prior_score", score)
        .withColumn("place", F.dense_rank().over(places).cast("long"))
        .drop("_lifts")
    )


def dominance(candidates: DataFrame, limit: int) -> DataFrame:
    """(query_id, most_held, dominated): a query's row of ``with_dominance``."""
    return with_dominance(candidates, limit).where(F.col("fused_rank") == 1).select("query_id", "most_held", "dominated")


def of_leaders(supported: DataFrame) -> DataFrame:
    """The candidates of the subjects that lead by the support of the books."""
    return supported.where(F.col("support_rank") <= DIFFERENTIAL_REMEDIES)


def best_of_subjects(ranked_candidates: DataFrame) -> DataFrame:
    """Each subject's first candidate of a query."""
    return top_k(ranked_candidates, ["query_id", "subject"], [F.col("fused_rank").asc()], 1, "_place").drop("_place")


def rank_share(place: Column) -> Column:
    """What a place in a ranking adds to a score."""
    return F.lit(1.0) / (F.lit(RRF_K) + place)


def select_best(candidates: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` best candidates of each query, as ``rank``.

    A dominated query keeps its fused order. Any other gets the best passage of each leading subject
    in the order of the subjects, then the leaders' other passages in fused order.
    """
    leader = F.col("place") <= DIFFERENTIAL_REMEDIES
    first = F.col("fused_rank") == F.col("first_rank")
    # One key orders both kinds: section 0 by place, section 1 by fused rank.
    section = F.when(F.col("dominated") | ~first, F.lit(1)).otherwise(F.lit(0))
    within = F.when(F.col("dominated") | ~first, F.col("fused_rank")).otherwise(F.col("place"))
    order = Window.partitionBy("query_id").orderBy("_section", "_within")
    return (
        candidates.filter(F.col("dominated") | leader)
        .withColumn("_section", section)
        .withColumn("_within", within)
        .withColumn("rank", F.row_number().over(order).cast("long"))
        .filter(F.col("rank") <= limit)
        .drop("_section", "_within")
    )
