"""Hybrid search as one plan over all queries and all passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions.fixed_values import PREFETCH
from quillrank.operators import bm25, fusion
from quillrank.operators.knn import nearest
from quillrank.sources.passages import fetch_payloads, passage_source
from quillrank.sources.shared import materialise


def dense_ranking(queries: DataFrame, passages: DataFrame, limit: int) -> DataFrame:
    """Each query's nearest passages of all books together.

    Dense scores compare across books, so the best of all books are the best of each book's best:
    the cut per book that a search of separate collections needs is not needed here.
    """
    keys = ["book_id", "book_ord", "id", "subject"]
    return nearest(queries, passages, limit * PREFETCH, ["query_id"], keys, ties=["book_ord", "id"])


def sparse_rankings(queries: DataFrame, passages: DataFrame, limit: int) -> DataFrame:
    """Each query's BM25 ranking in every book."""
    return bm25.search(queries, passages, limit * PREFETCH)


def candidates(rankings: DataFrame, limit: int, priors: DataFrame | None = None) -> DataFrame:
    """Every fused candidate with its rank, its subject's support and place, and the dominance."""
    found = fusion.with_dominance(fusion.ranked(fusion.fuse(rankings)), limit)
    return fusion.with_priors(fusion.with_support(found), priors)


def all_rankings(queries: DataFrame, passages: DataFrame, limit: int, texts: DataFrame | None = None) -> DataFrame:
    """The dense ranking and those of the books. ``texts`` are the same passages without ``embedding``: give them where vectors
    come by a join, and no text is shuffled to its vector."""
    sparse = sparse_rankings(queries, passages if texts is None else texts, limit)
    return fusion.union_rankings(dense_ranking(queries, passages, limit), sparse)


def search_candidates(
    queries: DataFrame, passages: DataFrame, limit: int, priors: DataFrame | None = None, texts: DataFrame | None = None
) -> DataFrame:
    return candidates(all_rankings(queries, passages, limit, texts), limit, priors)


def hybrid_search(
    queries: DataFrame, passages: DataFrame, limit: int, priors: DataFrame | None = None, texts: DataFrame | None = None
) -> DataFrame:
    """The best ``limit`` passages of each query as sources, with ``rank``; ``texts`` as in ``all_rankings``.

    Only keys are ranked; the payload is joined to the winners at the end.
    """
    return with_payloads(best_keys(queries, passages, limit, priors, texts), passages if texts is None else texts, ["query_id", "rank"])


def best_keys(
    queries: DataFrame, passages: DataFrame, limit: int, priors: DataFrame | None = None, texts: DataFrame | None = None
) -> DataFrame:
    """(query_id, rank, book_id, id, score) of the best ``limit`` passages of each query, as a table."""
    best = fusion.select_best(search_candidates(queries, passages, limit, priors, texts), limit)
    return materialise(best.select("query_id", "rank", "book_id", "id", "score"), "best")


def with_payloads(keys: DataFrame, passages: DataFrame, carried: list[str]) -> DataFrame:
    """Keys of passages as sources, beside the ``carried`` columns."""
    return fetch_payloads(keys, passages.drop("embedding", "subject", "book_ord")).select(*carried, *passage_source())


def search_stages(
    queries: DataFrame, passages: DataFrame, limit: int, priors: DataFrame | None = None, texts: DataFrame | None = None
) -> DataFrame:
    """Each stage of the search in long form: (query_id, stage, ranking_ord, pos, book_id, id, subject, score).

    ``support`` lists subjects, so its rows name no passage; a dominated query has none.
    """
    rankings = materialise(all_rankings(queries, passages, limit, texts), "rankings")
    found = materialise(candidates(rankings, limit, priors), "candidates")
    columns = ["query_id", "stage", "ranking_ord", "pos", "book_id", "id", "subject", "score"]
    none = F.lit(None)

    def stage(frame: DataFrame, name, pos: str, **extra) -> DataFrame:
        named = frame.withColumn("stage", name if not isinstance(name, str) else F.lit(name)).withColumn(
            "pos", F.col(pos).cast("long")
        )
        for column, value in extra.items():
            named = named.withColumn(column, value)
        return named.select(columns)

    zero = F.lit(0).cast("long")
    id_type = passages.schema["id"].dataType
    support = found.filter(~F.col("dominated") & (F.col("fused_rank") == F.col("first_rank")))
    parts = [
        stage(rankings, F.when(F.col("ranking_ord") == 0, F.lit("dense")).otherwise(F.lit("sparse")), "pos"),
        stage(found, "fused", "fused_rank", ranking_ord=zero),
        stage(
            support, "support", "place", ranking_ord=zero, book_id=none.cast("string"), id=none.cast(id_type), score=none.cast("double")
        ),
        stage(fusion.select_best(found, limit), "best", "rank", ranking_ord=zero),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def number_sources(passages: DataFrame, rubrics: DataFrame, key: str) -> DataFrame:
    """Passages and then rubrics of each query, numbered through from 1.

    Both sides are bounded per query, by the search's limit and by the rubrics an answer may cite.
    """
    both = passages.withColumn("_part", F.lit(0)).unionByName(rubrics.withColumn("_part", F.lit(1)))
    through = Window.partitionBy(key).orderBy("_part", "rank")
    return both.withColumn("number", F.row_number().over(through).cast("long")).drop("_part")
