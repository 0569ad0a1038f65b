"""Remedies that clinical terms list for the diseases a case names.

A term matches a disease when all of its words are among the disease's words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.functions.fixed_values import INDECISIVE_TIES, LEADING_REMEDIES
from quillrank.functions.words import term_words
from quillrank.operators.ordered import fixed_point, rank_in_group, top_k

RARITY_DIGITS = 12
RANKING = [("count", True), ("rarity", True), ("popularity", True)]


def with_words(frame: DataFrame, text: str) -> DataFrame:
    return frame.withColumn("words", term_words(F.col(text)))


def numbered(frame: DataFrame, ordinal: str) -> DataFrame:
    return frame if ordinal in frame.columns else frame.withColumn(ordinal, F.lit(0).cast("long"))


def matched_terms(diseases: DataFrame, terms: DataFrame) -> DataFrame:
    """The diseases' columns and the ``term``, the text of a term, for every term a disease matches.

    A term can only match a disease that has the term's rarest word, so that one word is the join
    key: a common word brings pairs together only for terms that have no rarer one. The remaining
    words are tested on the pair. A match has the order of its disease in the case and of its term in the
    catalog, ``disease_ord`` and ``term_ord``, which are 0 where the input has none.
    """
    asked = with_words(numbered(diseases, "disease_ord"), "disease").withColumnRenamed("words", "disease_words")
    words = asked.select(F.explode_outer("disease_words").alias("word"))
    frequency = words.groupBy("word").agg(F.count(F.lit(1)).alias("seen"))
    listed = with_words(numbered(terms, "term_ord").select("text", "term_ord"), "text").withColumnRenamed("words", "term_words").withColumnRenamed("text", "term")
    keyed = (
        listed.select("term", F.explode_outer("term_words").alias("word"))
        .join(frequency, "word", "left")
        .groupBy("term")
        .agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "word")).alias("rare"))
        .select("term", F.col("rare.word").alias("word"))
    )
    return (
        asked.withColumn("word", F.explode_outer("disease_words"))
        .join(listed.join(keyed, "term"), "word")
        .filter(F.size(F.array_except("term_words", "disease_words")) == 0)
        .drop("word", "disease_words", "term_words")
    )


def case_terms(matched: DataFrame, terms: DataFrame) -> DataFrame:
    """Distinct terms over all diseases of a case, with their first ``place`` and the remedies they list."""
    listed = terms.select(F.col("text").alias("term"), "remedies")
    first = matched.groupBy("case_id", "term").agg(F.min(F.struct("disease_ord", "term_ord")).alias("place"))
    return first.join(listed, "term")


def popularity(terms: DataFrame) -> DataFrame:
    """How many of all terms list each remedy."""
    return terms.select(F.explode("remedies").alias("remedy_id")).groupBy("remedy_id").agg(
        F.count(F.lit(1)).alias("popularity")
    )


def scores(found: DataFrame) -> DataFrame:
    """Per case and remedy: matched terms that list it, and how few remedies those terms list.

    A remedy that a term lists twice counts twice. The rarity is in whole units of the twelfth digit.
    """
    share = fixed_point(F.lit(1.0) / F.log(F.size("remedies") + F.lit(2.0)), RARITY_DIGITS)
    # The share is taken before the remedies are exploded, so that no row carries them all.
    listed = found.select("case_id", "remedies", share.alias("share")).select(
        "case_id", "share", F.explode("remedies").alias("remedy_id")
    )
    return listed.groupBy("case_id", "remedy_id").agg(
        F.count(F.lit(1)).alias("count"), F.sum("share").alias("rarity")
    )


def ranking(scored: DataFrame, popular: DataFrame) -> DataFrame:
    """Every remedy of a case with its rank: by count, rarity, popularity and id."""
    full = scored.join(popular, "remedy_id", "left").withColumn("popularity", F.coalesce("popularity", F.lit(0)))
    return rank_in_group(full, ["case_id"], RANKING, [F.col("remedy_id").asc()])


def decisive_match(scored: DataFrame) -> DataFrame:
    """Per case, whether several terms list the leader or few remedies share its place."""
    levels = scored.groupBy("case_id", "count").agg(F.count(F.lit(1)).alias("tied"))
    lead = levels.groupBy("case_id").agg(F.max("count").alias("lead"), F.max_by("tied", "count").alias("tied"))
    return lead.withColumn("decisive", (F.col("lead") > 1) | (F.col("tied") < INDECISIVE_TIES))


def first_remedies(scored: DataFrame, popular: DataFrame, limit: int = LEADING_REMEDIES) -> DataFrame:
    """The first remedies of the ranking; unlike coverage ranking, ties past the limit do not matter."""
    full = scored.join(popular, "remedy_id", "left").withColumn("popularity", F.coalesce("popularity", F.lit(0)))
    order = [F.col(name).desc() for name, _ in RANKING] + [F.col("remedy_id").asc()]
    return top_k(full, ["case_id"], order, limit).withColumn("rank", F.col("rank").cast("long"))


def remedy_terms(leaders: DataFrame, found: DataFrame) -> DataFrame:
    """The matched terms that list each leading remedy, with their ``place``; a term once, however often it lists it."""
    listed = found.select("case_id", "term", "place", F.explode(F.array_distinct("remedies")).alias("remedy_id"))
    return leaders.select("case_id", "remedy_id", "rank").join(listed, ["case_id", "remedy_id"])
