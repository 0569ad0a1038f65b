"""Queries of clinical matching."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillrank.functions.words import singular, term_words
from quillrank.operators import clinical as cl
from quillrank.plans.answers import gated_prior
from quillrank.registry import query
from quillrank.registry.clinical_sql import MATCHED, SINGULAR, WORDS
from quillrank.sources import passages as src
from quillrank.sources import views as v
from quillrank.sources.shared import materialise

def matched(spark, sf):
    return cl.matched_terms(v.diseases(spark, sf), src.catalog_of(v.clinical_terms(spark, sf)))


def case_terms(spark, sf):
    return cl.case_terms(matched(spark, sf), v.clinical_terms(spark, sf))


def scored(spark, sf):
    return cl.scores(case_terms(spark, sf))


@query("scan_clinical_terms", """
    SELECT array_to_string([p_type, p_name], ', ') AS text, lower(p_brand) AS remedy_id, p_partkey FROM part""")
def scan_clinical_terms(spark, sf):
    pair = F.struct(F.lower("p_brand").alias("remedy_id"), F.col("p_size").alias("grade"))
    stored = v.table(spark, sf, "part").select(
        "p_partkey", F.array("p_type", "p_name").alias("path"), F.array(pair).alias("pairs")
    )
    return src.catalog_of(src.term_records(stored, ["p_partkey"])).select(
        "p_partkey", "text", F.get("remedies", F.lit(0)).alias("remedy_id")
    )


@query("term_words", f"SELECT doc_id, array_to_string({WORDS.format(t='text')}, ' ') AS words FROM documents")
def term_word_sets(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", F.array_join(term_words(F.col("text")), " ").alias("words"))


@query("singular", f"""
    SELECT DISTINCT word, {SINGULAR.format(w="word")} AS singular FROM (
      SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)""")
def singulars(spark, sf):
    found = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    return v.table(spark, sf, "documents").select(found.alias("word")).distinct().select(
        "word", singular(F.col("word")).alias("singular")
    )


@query("term_containment", MATCHED + "SELECT case_id, term FROM matched")
def term_containment(spark, sf):
    return matched(spark, sf).select("case_id", "term")


@query("matched_terms", MATCHED + "SELECT DISTINCT case_id, term FROM matched")
def matched_terms(spark, sf):
    return case_terms(spark, sf).select("case_id", "term")


@query("term_popularity", MATCHED + "SELECT remedy_id, popularity FROM popular")
def term_popularity(spark, sf):
    return cl.popularity(v.clinical_terms(spark, sf))


@query("clinical_scores", MATCHED + "SELECT case_id, remedy_id, count, rarity FROM scored")
def clinical_scores(spark, sf):
    return scored(spark, sf)


@query("clinical_ranking", MATCHED + "SELECT case_id, remedy_id, rank FROM ranked")
def clinical_ranking(spark, sf):
    ranked = cl.ranking(scored(spark, sf), cl.popularity(v.clinical_terms(spark, sf)))
    return ranked.select("case_id", "remedy_id", "rank")


@query("decisive_match", MATCHED + "SELECT case_id, lead, tied, decisive FROM gate")
def decisive_match(spark, sf):
    return cl.decisive_match(scored(spark, sf))


@query("clinical_gate", MATCHED + """
    SELECT case_id, 'remedy:' || remedy_id AS subject, rank AS place FROM ranked JOIN gate USING (case_id) WHERE decisive""")
def clinical_gate(spark, sf):
    found = materialise(scored(spark, sf), "clinical-scores")
    return gated_prior(cl.ranking(found, cl.popularity(v.clinical_terms(spark, sf))), cl.decisive_match(found))


@query("leading_clinical", MATCHED + "SELECT case_id, remedy_id, rank FROM ranked WHERE rank <= 3")
def leading_clinical(spark, sf):
    first = cl.first_remedies(scored(spark, sf), cl.popularity(v.clinical_terms(spark, sf)))
    return first.select("case_id", "remedy_id", "rank")


@query("remedy_terms", MATCHED + """
    SELECT *, row_number() OVER (PARTITION BY case_id, remedy_id ORDER BY place) AS term_no FROM (
      SELECT r.case_id, r.remedy_id, r.rank, m.term, min(m.disease_ord * 1000000000 + m.term_ord) AS place FROM ranked r JOIN matched m
      ON m.case_id = r.case_id AND list_contains(m.remedies, r.remedy_id) WHERE r.rank <= 3 GROUP BY ALL)""")
def remedy_terms(spark, sf):
    found = case_terms(spark, sf)
    leaders = cl.first_remedies(cl.scores(found), cl.popularity(v.clinical_terms(spark, sf)))
    place = F.col("place.disease_ord").cast("long") * 1_000_000_000 + F.col("place.term_ord")
    # A remedy of a case has at most the terms that the case matches.
    order = Window.partitionBy("case_id", "remedy_id").orderBy("place")
    listed = cl.remedy_terms(leaders, found).withColumn("place", place)
    return listed.withColumn("term_no", F.row_number().over(order).cast("long"))


@query("clinical_match", MATCHED + """
    SELECT r.case_id, r.remedy_id, r.count, r.rarity, r.popularity, r.rank, g.decisive
    FROM ranked r JOIN gate g USING (case_id)""")
def clinical_match(spark, sf):
    found = materialise(scored(spark, sf), "clinical-scores")
    ranked = cl.ranking(found, cl.popularity(v.clinical_terms(spark, sf)))
    return ranked.join(cl.decisive_match(found).select("case_id", "decisive"), "case_id").select(
        "case_id", "remedy_id", "count", "rarity", "popularity", "rank", "decisive"
    )
