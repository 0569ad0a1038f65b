"""Queries of the hybrid search and its parts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.functions.fixed_values import MAX_CITATION_CHARS
from quillrank.functions.paths import aphorism_label, section_title, subject_key
from quillrank.operators import bm25, fusion
from quillrank.operators.knn import nearest
from quillrank.operators.ordered import top_k
from quillrank.operators.segments import Index
from quillrank.plans import retrieval as plan
from quillrank.registry import query
from quillrank.sources import passages as src
from quillrank.sources import views as v
from quillrank.sources.shared import shared_folder

LIMIT = 5


def rounded(column: str = "score", digits: int = 6):
    return F.round(column, digits).alias(column)


def rankings(spark, sf) -> DataFrame:
    texts = v.passages(spark, sf, vectors=False)
    return plan.all_rankings(v.search_queries(spark, sf), v.passages(spark, sf), LIMIT, texts)


def fused(spark, sf) -> DataFrame:
    return fusion.ranked(fusion.fuse(rankings(spark, sf)))


def priors(spark, sf) -> DataFrame:
    """Two prior rankings of eight remedies for each query, by a rule."""
    places = v.search_queries(spark, sf).select(
        "query_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("o")
    ).select("query_id", "o", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("p"))
    number = (F.col("query_id") * (F.lit(3) + F.col("o")) + F.col("p") * 5) % 41
    return places.select(
        "query_id",
        F.col("o").cast("long").alias("prior_ord"),
        F.concat(F.lit("remedy:remedy-"), number.cast("string")).alias("subject"),
        F.col("p").cast("long").alias("place"),
    )


# Scans -----------------------------------------------------------------------------------------


@query("scan_passages", "SELECT book_id, id, subject, content FROM v_passages")
def scan_passages(spark, sf):
    return v.passages(spark, sf, vectors=False).select("book_id", "id", "subject", "content")


@query("fetch_payloads", """
    SELECT q.query_id, p.book_id, p.id, p.chunk_id, p.content FROM v_queries q
    JOIN v_passages p ON p.id = (q.query_id * 7919) % (SELECT count(*) FROM documents)""")
def fetch_payloads(spark, sf):
    # The number of documents is one row; winners lie all over them.
    total = v.table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n")).first()["n"]
    winners = v.search_queries(spark, sf).select("query_id", ((F.col("query_id") * 7919) % total).alias("id"))
    keyed = winners.withColumn("book_id", F.concat(F.lit("book"), (F.col("id") % v.BOOKS).cast("string")))
    payload = v.passages(spark, sf, vectors=False).select("book_id", "id", "chunk_id", "content")
    return src.fetch_payloads(keyed, payload).select("query_id", "book_id", "id", "chunk_id", "content")


@query("fetch_payloads_stored", """
    SELECT q.query_id, p.book_id, p.id, p.chunk_id, p.source_title, p.chunk_index, p.content FROM v_queries q
    JOIN v_passages p ON p.id = (q.query_id * 7919) % (SELECT count(*) FROM documents)""")
def fetch_payloads_stored(spark, sf):
    total = v.table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n")).first()["n"]
    winners = v.search_queries(spark, sf).select("query_id", ((F.col("query_id") * 7919) % total).alias("id"))
    keyed = winners.withColumn("book_id", F.concat(F.lit("book"), (F.col("id") % v.BOOKS).cast("string")))
    path = f"{shared_folder(spark)}/stores/payloads-{uuid.uuid4().hex}"
    src.store_payloads(v.passages(spark, sf, vectors=False), path, 64)
    return src.fetch_stored(keyed, path, 64).select("query_id", "book_id", "id", "chunk_id", "source_title", "chunk_index", "content")


@query("missing_collections", """
    SELECT e.book_id FROM (SELECT 'book' || r_regionkey * 2 AS book_id FROM region) e
    WHERE e.book_id NOT IN (SELECT book_id FROM v_passages)""")
def missing_collections(spark, sf):
    expected = v.table(spark, sf, "region").select(
        F.concat(F.lit("book"), (F.col("r_regionkey") * 2).cast("string")).alias("book_id")
    )
    return src.missing_collections(expected, v.passages(spark, sf, vectors=False)).orderBy("book_id")


@query("attach_embeddings", """
    SELECT b.item_id, b.text, len(e.embedding)::BIGINT AS dimensions,
           CASE WHEN e.embedding IS NULL THEN 'no embedding' WHEN len(e.embedding) <> 64 THEN 'wrong dimensions' END AS problem
    FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id * 20""")
def attach_embeddings(spark, sf):
    texts = v.table(spark, sf, "benchmark").withColumn("vec_id", F.col("item_id") * 20)
    vectors = v.table(spark, sf, "embeddings").select("vec_id", "embedding")
    found = src.attach_embeddings(texts, vectors, ["vec_id"], dimensions=64)
    size = F.when(F.col("embedding").isNotNull(), F.size("embedding").cast("long"))
    return found.select("item_id", "text", size.alias("dimensions"), "problem")


# Projections -----------------------------------------------------------------------------------

SECTIONS_SQL = """
    CASE WHEN coalesce(section_group, '') <> '' AND joined <> '' THEN section_group || ': ' || joined
         WHEN coalesce(section_group, '') <> '' THEN section_group ELSE joined END"""
LABEL_SQL = """
    CASE WHEN len(aphorisms) = 1 THEN '§ ' || aphorisms[1]
         WHEN len(aphorisms) > 1 AND aphorisms[2] = aphorisms[1] + 1 THEN '§§ ' || aphorisms[1] || '–' || aphorisms[-1]
         WHEN len(aphorisms) > 1 THEN '§§ ' || array_to_string(aphorisms, ', ') END"""
TITLED_SQL = f"""
    WITH labelled AS (SELECT *, {LABEL_SQL} AS label FROM v_passages),
    titled AS (SELECT *, array_to_string(list_concat(
        list_filter(sections, lambda s: s <> coalesce(section_group, '')),
        CASE WHEN label IS NULL THEN CAST([] AS VARCHAR[]) ELSE [label] END), '; ') AS joined FROM labelled)"""


@query("passage_source", TITLED_SQL + f"""
    SELECT chunk_id, book_id, source_title AS book_title, author, remedy AS remedy_name, {SECTIONS_SQL} AS section_title,
           chunk_index AS passage_index, content AS text, 0.0::DOUBLE AS score FROM titled""")
def passage_source(spark, sf):
    rows = v.passages(spark, sf, vectors=False).select(*src.passage_source(F.lit(0.0)))
    return rows.withColumn("passage_index", F.get("passage_indexes", F.lit(0))).drop("passage_indexes")


@query("section_title", TITLED_SQL + f" SELECT id, {SECTIONS_SQL} AS section_title FROM titled")
def section_titles(spark, sf):
    title = section_title(F.col("section_group"), F.col("sections"), F.col("aphorisms"))
    return v.passages(spark, sf, vectors=False).select("id", title.alias("section_title"))


@query("aphorism_label", f"SELECT id, {LABEL_SQL} AS label FROM v_passages")
def aphorism_labels(spark, sf):
    return v.passages(spark, sf, vectors=False).select("id", aphorism_label(F.col("aphorisms")).alias("label"))


@query("required_fields", r"""
    WITH raw AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_type END AS chunk_id,
                        CASE WHEN event_id % 7 = 0 THEN CAST(value AS VARCHAR) ELSE json_extract_string(props, '$.k') END AS chunk_index
                 FROM events)
    SELECT event_id, CASE WHEN chunk_id IS NULL THEN 'no chunk_id'
      WHEN chunk_index IS NULL OR NOT regexp_full_match(chunk_index, '[+-]?\d+') THEN 'no integer chunk_index' END AS problem
    FROM raw""")
def required_fields(spark, sf):
    index = F.when(F.col("event_id") % 7 == 0, F.col("value").cast("string")).otherwise(
        F.get_json_object("props", "$.k")
    )
    raw = v.table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("chunk_id"),
        index.alias("chunk_index"),
    )
    return src.check_required(raw, ["chunk_id"], ["chunk_index"]).select("event_id", "problem")


@query("subject_key", "SELECT id, subject FROM v_passages")
def subject_keys(spark, sf):
    return v.passages(spark, sf, vectors=False).select("id", subject_key(F.col("book_id"), F.col("remedy_id")).alias("subject"))


# Rankings --------------------------------------------------------------------------------------


@query("dense_knn", """
    SELECT query_id, book_id, id, pos, round(score, 6) AS score FROM (
      SELECT query_id, book_id, id, score, row_number() OVER (PARTITION BY query_id, book_id ORDER BY score DESC, id) AS pos
      FROM (SELECT q.query_id, p.book_id, p.id,
                   round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 9) AS score
            FROM v_queries q CROSS JOIN v_passages p)) WHERE pos <= 10""")
def dense_knn(spark, sf):
    found = nearest(
        v.search_queries(spark, sf), v.passages(spark, sf), 10, ["query_id"], ["book_id", "id"], within=["book_id"], ties=["id"]
    )
    return found.select("query_id", "book_id", "id", F.col("pos").cast("long").alias("pos"), rounded())


@query("bm25_topk", "SELECT query_id, book_id, id, pos, round(score, 6) AS score FROM v_sparse WHERE pos <= 10")
def bm25_topk(spark, sf):
    found = bm25.search(v.search_queries(spark, sf), v.passages(spark, sf, vectors=False), 10)
    return found.select("query_id", "book_id", "id", F.col("pos").cast("long").alias("pos"), rounded())


@query("search_index", "SELECT query_id, book_id, id, pos, round(score, 6) AS score FROM v_sparse WHERE pos <= 10")
def search_index(spark, sf):
    """Through the stored index, after passages came in two segments, some of them out of date, and others went again."""
    passages = v.passages(spark, sf, vectors=False).select("book_ord", "id", "book_id", "subject", "content")
    index = Index(spark, f"{shared_folder(spark)}/stores/index-{uuid.uuid4().hex}")
    odd = F.col("id") % 2 == 1
    stale = passages.where(odd & (F.col("id") % 3 == 0)).withColumn("content", F.concat("content", F.lit(" "), "content"))
    extra = passages.where(F.col("id") % 5 == 0).withColumn("id", -1 - F.col("id"))
    index.add(passages.where(~odd).unionByName(stale).unionByName(extra))
    index.add(passages.where(odd))
    index.remove(extra.select("book_ord", "id"))
    found = index.search(v.search_queries(spark, sf), 10)
    return found.select("query_id", "book_id", "id", F.col("pos").cast("long").alias("pos"), rounded())


@query("global_dense_rank", "SELECT query_id, book_id, id, pos, round(score, 6) AS score FROM v_dense")
def global_dense_rank(spark, sf):
    found = plan.dense_ranking(v.search_queries(spark, sf), v.passages(spark, sf), LIMIT)
    return found.select("query_id", "book_id", "id", F.col("pos").cast("long").alias("pos"), rounded())


@query("per_book_rank", "SELECT query_id, book_id, id, pos FROM v_sparse")
def per_book_rank(spark, sf):
    found = plan.sparse_rankings(v.search_queries(spark, sf), v.passages(spark, sf, vectors=False), LIMIT)
    return found.select("query_id", "book_id", "id", F.col("pos").cast("long").alias("pos"))


@query("prefetch", """
    SELECT query_id, ranking_ord, count(*) AS rows, max(pos) AS last FROM v_rankings GROUP BY ALL""")
def prefetch(spark, sf):
    return (
        rankings(spark, sf)
        .groupBy("query_id", "ranking_ord")
        .agg(F.count(F.lit(1)).alias("rows"), F.max("pos").cast("long").alias("last"))
    )


@query("union_rankings", "SELECT query_id, ranking_ord, pos, book_id, id, subject FROM v_rankings")
def union_rankings(spark, sf):
    return rankings(spark, sf).select(
        "query_id", "ranking_ord", F.col("pos").cast("long").alias("pos"), "book_id", "id", "subject"
    )


@query("rrf_scores", "SELECT query_id, book_id, id, round(score, 9) AS score FROM v_fused")
def rrf_scores(spark, sf):
    return fusion.fuse(rankings(spark, sf)).select("query_id", "book_id", "id", rounded(digits=9))


@query("fuse_rankings", """
    SELECT query_id, book_id, id, subject, first_ranking, first_pos, fused_rank FROM v_fused""")
def fuse_rankings(spark, sf):
    return fused(spark, sf).select(
        "query_id",
        "book_id",
        "id",
        "subject",
        F.col("first.ranking_ord").alias("first_ranking"),
        F.col("first.pos").cast("long").alias("first_pos"),
        "fused_rank",
    )


@query("top_candidates", "SELECT query_id, book_id, id, fused_rank AS rank FROM v_fused WHERE fused_rank <= 10")
def top_candidates(spark, sf):
    order = [F.col("score").desc(), F.col("first").asc()]
    return top_k(fusion.fuse(rankings(spark, sf)), ["query_id"], order, 10).select(
        "query_id", "book_id", "id", F.col("rank").cast("long").alias("rank")
    )


@query("dominated", "SELECT query_id, most_held, dominated FROM v_dominated")
def dominated(spark, sf):
    return fusion.dominance(fused(spark, sf), LIMIT)


@query("book_support", "SELECT query_id, subject, support, support_rank FROM v_support")
def book_support(spark, sf):
    found = fusion.with_support(fused(spark, sf))
    return found.filter(F.col("fused_rank") == F.col("first_rank")).select(
        "query_id", "subject", "support", "support_rank"
    )


@query("support_with_priors", "SELECT query_id, subject, prior_score, place FROM v_places")
def support_with_priors(spark, sf):
    found = fusion.with_priors(fusion.with_support(fused(spark, sf)), priors(spark, sf))
    return found.filter(F.col("fused_rank") == F.col("first_rank")).select("query_id", "subject", "prior_score", "place")


@query("leader_passages", """
    SELECT f.query_id, f.book_id, f.id, f.subject FROM v_fused f
    SEMI JOIN (SELECT * FROM v_support WHERE support_rank <= 5) s ON s.query_id = f.query_id AND s.subject = f.subject""")
def leader_passages(spark, sf):
    return fusion.of_leaders(fusion.with_support(fused(spark, sf))).select("query_id", "book_id", "id", "subject")


@query("best_passage_per_subject", """
    SELECT query_id, subject, arg_min(book_id, fused_rank) AS book_id, arg_min(id, fused_rank) AS id FROM v_fused GROUP BY ALL""")
def best_passage_per_subject(spark, sf):
    return fusion.best_of_subjects(fused(spark, sf)).select("query_id", "subject", "book_id", "id")


@query("select_regrouped", """
    SELECT query_id, rank, book_id, id, subject FROM (
      SELECT f.query_id, f.book_id, f.id, f.subject, row_number() OVER (PARTITION BY f.query_id ORDER BY
               f.fused_rank <> p.first_rank, CASE WHEN f.fused_rank = p.first_rank THEN p.place ELSE f.fused_rank END) AS rank
      FROM v_fused f JOIN v_places p ON p.query_id = f.query_id AND p.subject = f.subject
      JOIN v_dominated d ON d.query_id = f.query_id WHERE NOT d.dominated AND p.place <= 5) WHERE rank <= 5""")
def select_regrouped(spark, sf):
    found = plan.candidates(rankings(spark, sf), LIMIT, priors(spark, sf)).filter(~F.col("dominated"))
    return fusion.select_best(found, LIMIT).select("query_id", "rank", "book_id", "id", "subject")


# Whole searches --------------------------------------------------------------------------------


@query("hybrid_search", TITLED_SQL + f"""
    SELECT b.query_id, b.rank, b.book_id, t.chunk_id, t.source_title AS book_title, t.author, t.remedy AS remedy_name,
           {SECTIONS_SQL} AS section_title, t.chunk_index AS passage_index, t.content AS text, round(b.score, 9) AS score
    FROM v_best b JOIN titled t ON t.id = b.id""")
def hybrid_search(spark, sf):
    texts = v.passages(spark, sf, vectors=False)
    found = plan.hybrid_search(v.search_queries(spark, sf), v.passages(spark, sf), LIMIT, texts=texts)
    return found.withColumn("passage_index", F.get("passage_indexes", F.lit(0))).drop("passage_indexes").withColumn(
        "score", F.round("score", 9)
    )


@query("search_stages", """
    SELECT query_id, CASE WHEN ranking_ord = 0 THEN 'dense' ELSE 'sparse' END AS stage, ranking_ord, pos, book_id, id,
           subject, round(score, 6) AS score FROM v_rankings
    UNION ALL SELECT query_id, 'fused', 0, fused_rank, book_id, id, subject, round(score, 6) FROM v_fused
    UNION ALL SELECT p.query_id, 'support', 0, p.support_rank, NULL, NULL, p.subject, NULL
      FROM v_support p JOIN v_dominated d USING (query_id) WHERE NOT d.dominated
    UNION ALL SELECT query_id, 'best', 0, rank, book_id, id, subject, round(score, 6) FROM v_best""")
def search_stages(spark, sf):
    texts = v.passages(spark, sf, vectors=False)
    found = plan.search_stages(v.search_queries(spark, sf), v.passages(spark, sf), LIMIT, texts=texts)
    return found.withColumn("score", F.round("score", 6))


@query("citations", TITLED_SQL + f"""
    SELECT 'corpus/' || book_id || '/' || chunk_id AS id, book_id, source_title AS book_title, author,
           remedy AS remedy_name, {SECTIONS_SQL} AS section_title, chunk_index AS passage_index, content AS text FROM titled""")
def citations(spark, sf):
    rows = src.citations(v.passages(spark, sf, vectors=False).select(*src.passage_source(F.lit(0.0))))
    return rows.withColumn("passage_index", F.get("passage_indexes", F.lit(0))).drop("passage_indexes")


@query("oversize_sources", """
    SELECT id // 20 AS query_id, max(length(content)) AS longest, bool_or(length(content) > 8000) AS rejected
    FROM v_passages GROUP BY ALL""")
def oversize_sources(spark, sf):
    sources = v.passages(spark, sf, vectors=False).select(F.floor(F.col("id") / 20).alias("query_id"), F.col("content").alias("text"))
    return src.oversize_queries(sources, MAX_CITATION_CHARS)
