"""Queries of graded coverage ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrank.operators import repertory as rep
from quillrank.plans import repertorise as plan
from quillrank.registry import query
from quillrank.sources import passages as src
from quillrank.sources import views as v


def hits(spark, sf):
    """``rubric_hits`` with the rubric's place: its id, and the single repertory it is from."""
    return v.rubric_hits(spark, sf).select(
        "case_id",
        "symptom_ord",
        F.col("rubric_id").alias("rubric_ord"),
        F.lit("repertory0").alias("book_id"),
        "rubric_id",
        "remedy_id",
        "grade",
    )


def books(spark, sf):
    """The catalog: only the first repertory is in it, so the other is titled by its id."""
    return v.table(spark, sf, "region").filter(F.col("r_regionkey") == 0).select(
        F.lit("repertory0").alias("book_id"),
        F.concat(F.lit("Repertory of "), "r_name").alias("book_title"),
        F.col("r_name").alias("author"),
    )


def run(spark, sf):
    return plan.repertorise(v.case_symptoms(spark, sf), v.rubrics(spark, sf))


@query("scan_rubrics", """
    SELECT book_id, id, chapter, text, len(remedies)::BIGINT AS listed, CAST(NULL AS VARCHAR) AS problem FROM v_rubrics""")
def scan_rubrics(spark, sf):
    checked = src.rubric_problems(v.rubrics(spark, sf))
    return checked.select("book_id", "id", "chapter", "text", F.size("remedies").cast("long").alias("listed"), "problem")


@query("symptom_rubrics", """
    SELECT case_id, symptom_ord, book_id, rubric_id, pos, round(score, 6) AS score FROM v_symptom_rubrics""")
def symptom_rubrics(spark, sf):
    found = plan.symptom_rubrics(v.case_symptoms(spark, sf), v.rubrics(spark, sf))
    return found.select(
        "case_id",
        "symptom_ord",
        "book_id",
        "rubric_id",
        F.col("pos").cast("long").alias("pos"),
        F.round("score", 6).alias("score"),
    )


@query("combined_rubrics", "SELECT case_id, symptom_ord, rubric_ord, book_id, rubric_id FROM v_combined")
def combined_rubrics(spark, sf):
    return plan.combined(plan.symptom_rubrics(v.case_symptoms(spark, sf), v.rubrics(spark, sf)))


@query("distinct_matches", "SELECT case_id, symptom_ord, rubric_ord, book_id, rubric_id FROM v_matches")
def distinct_matches(spark, sf):
    found = plan.combined(plan.symptom_rubrics(v.case_symptoms(spark, sf), v.rubrics(spark, sf)))
    return rep.distinct_matches(found)


@query("best_grades", """
    SELECT case_id, symptom_ord, remedy_id, max(grade) AS grade FROM v_rubric_hits GROUP BY ALL""")
def best_grades(spark, sf):
    return rep.best_grades(v.rubric_hits(spark, sf))


@query("rank_remedies", "SELECT case_id, remedy_id, symptoms, grades, rank FROM v_ranked_remedies")
def rank_remedies(spark, sf):
    return rep.rank_remedies(v.rubric_hits(spark, sf)).select("case_id", "remedy_id", "symptoms", "grades", "rank")


@query("decisive", "SELECT case_id, case_symptoms, lead, tied, decisive FROM v_decisive")
def decisive(spark, sf):
    counts = rep.symptom_counts(v.rubric_matches(spark, sf))
    return rep.decisive(rep.coverage(v.rubric_hits(spark, sf)), counts)


@query("repertory_gate", """
    SELECT r.case_id, 'remedy:' || r.remedy_id AS subject, r.rank AS place
    FROM v_ranked_remedies r JOIN v_decisive d USING (case_id) WHERE d.decisive""")
def repertory_gate(spark, sf):
    from quillrank.plans.answers import gated_prior

    found = v.rubric_hits(spark, sf)
    gate = rep.decisive(rep.coverage(found), rep.symptom_counts(v.rubric_matches(spark, sf)))
    return gated_prior(rep.rank_remedies(found), gate)


@query("standing_out", "SELECT case_id, remedy_id, symptoms, grades, leader_ord FROM v_leaders")
def standing_out(spark, sf):
    return rep.standing_out(rep.coverage(v.rubric_hits(spark, sf)))


@query("best_rubric", "SELECT case_id, symptom_ord, leader_ord, remedy_id, grade, rubric_id FROM v_best_rubrics")
def best_rubric(spark, sf):
    found = hits(spark, sf)
    best = rep.best_rubrics(rep.standing_out(rep.coverage(found)), found)
    return best.select("case_id", "symptom_ord", "leader_ord", "remedy_id", "grade", "rubric_id")


@query("cited_rubric_numbers", """
    SELECT b.case_id, b.symptom_ord, b.leader_ord, b.rubric_id, c.number
    FROM v_best_rubrics b LEFT JOIN v_cited c ON c.case_id = b.case_id AND c.rubric_id = b.rubric_id""")
def cited_rubric_numbers(spark, sf):
    found = hits(spark, sf)
    best = rep.best_rubrics(rep.standing_out(rep.coverage(found)), found)
    matched = rep.matched_symptoms(best, rep.number_rubrics(best, 6))
    return matched.select("case_id", "symptom_ord", "leader_ord", "rubric_id", "number")


@query("rubric_listing", """
    WITH listed AS (
      SELECT h.rubric_id, h.remedy_id, h.grade, count(*) OVER (PARTITION BY h.rubric_id) AS n,
             row_number() OVER (PARTITION BY h.rubric_id ORDER BY coalesce(l.leader_ord, 99), h.grade DESC, h.remedy_id) AS place
      FROM v_rubric_hits h LEFT JOIN v_leaders l ON l.case_id = h.case_id AND l.remedy_id = h.remedy_id)
    SELECT rubric_id, 'Remedies and their grades: '
             || string_agg(upper(remedy_id[1]) || replace(substr(remedy_id, 2), '-', ' ') || ' (' || grade || ')', ', ' ORDER BY place)
             || CASE WHEN any_value(n) > 3 THEN ', and ' || (any_value(n) - 3) || ' more' ELSE '' END AS text
    FROM listed WHERE place <= 3 GROUP BY rubric_id""")
def rubric_listing(spark, sf):
    found = v.rubric_hits(spark, sf)
    leaders = rep.standing_out(rep.coverage(found)).select("case_id", "remedy_id", "leader_ord")
    listed = found.join(leaders, ["case_id", "remedy_id"], "left").withColumn("listed_ord", F.col("remedy_id"))
    return rep.rubric_listing(listed, ["rubric_id"], shown=3)


@query("rubric_book", """
    SELECT r.id, r.book_id, coalesce(b.book_title, r.book_id) AS book_title, b.author FROM v_rubrics r LEFT JOIN
      (SELECT 'repertory0' AS book_id, 'Repertory of ' || r_name AS book_title, r_name AS author FROM region WHERE r_regionkey = 0) b
    ON b.book_id = r.book_id""")
def rubric_book(spark, sf):
    named = rep.with_book(v.rubrics(spark, sf).select("id", "book_id"), books(spark, sf))
    return named.select("id", "book_id", "book_title", "author")


@query("rubric_title", "SELECT doc_id, left(text, 500) AS title FROM documents")
def rubric_title(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", rep.rubric_title(F.col("text")).alias("title"))


@query("remedy_name", """
    SELECT DISTINCT remedy_id, upper(remedy_id[1]) || replace(substr(remedy_id, 2), '-', ' ') AS name FROM v_rubric_hits""")
def remedy_names(spark, sf):
    return v.rubric_hits(spark, sf).select("remedy_id").distinct().select(
        "remedy_id", rep.remedy_name(F.col("remedy_id")).alias("name")
    )


@query("repertorise", """
    SELECT c.case_id, c.remedy_id, c.symptoms, c.grades, d.decisive, row_number() OVER (
      PARTITION BY c.case_id ORDER BY c.symptoms DESC, c.grades DESC, c.remedy_id) AS rank
    FROM v_case_coverage c JOIN v_case_decisive d USING (case_id)""")
def repertorise(spark, sf):
    found = run(spark, sf)
    ranked = rep.rank_in_group(found.covered, ["case_id"], rep.RANKING, [F.col("remedy_id").asc()])
    return ranked.join(found.decisive.select("case_id", "decisive"), "case_id").select(
        "case_id", "remedy_id", "symptoms", "grades", "decisive", "rank"
    )


@query("leading_remedies", """
    SELECT b.case_id, b.leader_ord, upper(b.remedy_id[1]) || replace(substr(b.remedy_id, 2), '-', ' ') AS remedy_name,
           b.symptom_ord, n.number, n.text
    FROM v_case_best b LEFT JOIN v_case_sources n USING (case_id, book_id, rubric_id)""")
def leading_remedies(spark, sf):
    remedies, sources = plan.leading_remedies(run(spark, sf), v.rubrics(spark, sf), books(spark, sf), 6)
    return remedies.join(sources.select("case_id", "number", "text"), ["case_id", "number"], "left").select(
        "case_id", "leader_ord", "remedy_name", "symptom_ord", "number", "text"
    )
