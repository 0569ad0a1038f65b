"""The engine's inputs as views over the given tables.

The tables hold no text of the domain, so each input (passages, rubrics, terms, cases, chats) is
derived from them by a rule. Each view covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions.paths import subject_key

BOOKS = 7


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_of(number: Column) -> Column:
    return number.cast("string")


def epoch_ms(ts: Column) -> Column:
    """Milliseconds of a time without zone that is read as UTC, whatever the session's zone."""
    return F.unix_millis(F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp"))


def passages(spark: SparkSession, sf: str, vectors: bool = True) -> DataFrame:
    """Every document, with a vector of ``embeddings`` in turn: seven books, the sixth without remedies.

    Without ``vectors`` for work on texts alone: no text is shuffled to the vectors.
    """
    documents = table(spark, sf, "documents")
    if vectors:
        embeddings = table(spark, sf, "embeddings").select(F.col("vec_id").alias("_vector"), "embedding")
        # The number of vectors is one row; documents beyond it take them again from the first.
        number = embeddings.agg(F.count(F.lit(1)).alias("n")).first()["n"]
        documents = documents.withColumn("_vector", F.col("doc_id") % max(1, number)).join(embeddings, "_vector", "left")
    book = F.col("doc_id") % BOOKS
    number = F.col("doc_id")
    book_id = F.concat(F.lit("book"), text_of(book))
    remedy_id = F.when(book != 5, F.concat(F.lit("remedy-"), text_of(number % 41)))
    aphorisms = F.when(
        book == 5,
        F.when(number % 3 == 0, F.array(number))
        .when(number % 3 == 1, F.array(number, number + 1))
        .otherwise(F.array(number, number + 4)),
    )
    return documents.select(
        book.alias("book_ord"),
        book_id.alias("book_id"),
        number.alias("id"),
        F.concat(F.lit("chunk-"), text_of(number)).alias("chunk_id"),
        F.concat(F.lit("Book "), text_of(book)).alias("source_title"),
        F.when(book % 2 == 0, F.concat(F.lit("Author "), text_of(book))).alias("author"),
        remedy_id.alias("remedy_id"),
        F.when(remedy_id.isNotNull(), F.concat(F.lit("Remedy "), text_of(number % 41))).alias("remedy"),
        F.when(number % 4 != 0, F.col("lang")).alias("section_group"),
        F.array("source", "lang").alias("sections"),
        aphorisms.alias("aphorisms"),
        (number % 10).alias("chunk_index"),
        F.col("text").alias("content"),
        subject_key(book_id, remedy_id).alias("subject"),
        *(["embedding"] if vectors else []),
    )


def search_queries(spark: SparkSession, sf: str) -> DataFrame:
    """benchmark x embeddings: a text with its vector."""
    embeddings = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return table(spark, sf, "benchmark").join(embeddings, "item_id").select(
        F.col("item_id").alias("query_id"), "text", "embedding"
    )


def case_symptoms(spark: SparkSession, sf: str) -> DataFrame:
    """Five search queries make the symptoms of one case."""
    return search_queries(spark, sf).select(
        F.floor(F.col("query_id") / 5).alias("case_id"),
        (F.col("query_id") % 5).alias("symptom_ord"),
        F.col("text").alias("symptom"),
        "embedding",
    )


def rubrics(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as rubrics of two repertories, each with five graded remedies."""
    number = F.col("vec_id")
    remedies = [
        F.struct(
            F.concat(F.lit("remedy-"), text_of((number * (j + 3) + j * 7) % 41)).alias("remedy_id"),
            ((number + j) % 3 + 1).alias("grade"),
        )
        for j in range(5)
    ]
    return table(spark, sf, "embeddings").select(
        (number % 2).alias("repertory_ord"),
        F.concat(F.lit("repertory"), text_of(number % 2)).alias("book_id"),
        number.alias("id"),
        F.concat(F.lit("Chapter "), text_of(F.col("label"))).alias("chapter"),
        F.concat(F.lit("Chapter "), text_of(F.col("label")), F.lit(": rubric "), text_of(number)).alias("text"),
        F.array(*remedies).alias("remedies"),
        "embedding",
    )


def rubric_hits(spark: SparkSession, sf: str) -> DataFrame:
    """orders x lineitem: a customer's orders are matched rubrics, their suppliers graded remedies."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("rubric_id"),
        F.col("o_custkey").alias("case_id"),
        F.substring("o_orderpriority", 1, 1).cast("long").alias("symptom_ord"),
    )
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("rubric_id"),
        F.concat(F.lit("remedy-"), text_of(F.col("l_suppkey"))).alias("remedy_id"),
        (F.floor("l_quantity") % 3 + 1).alias("grade"),
    )
    # Lines are combined per rubric and remedy before the join, so repeated pairs are not shuffled.
    listed = lines.groupBy("rubric_id", "remedy_id").agg(F.max("grade").alias("grade"))
    return listed.join(orders, "rubric_id").select("case_id", "symptom_ord", "rubric_id", "remedy_id", "grade")


def rubric_matches(spark: SparkSession, sf: str) -> DataFrame:
    """orders as matches (case, symptom, rubric): the rubrics of ``rubric_hits`` by themselves."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("case_id"),
        F.substring("o_orderpriority", 1, 1).cast("long").alias("symptom_ord"),
        F.col("o_orderkey").alias("rubric_id"),
    )


def clinical_terms(spark: SparkSession, sf: str) -> DataFrame:
    """part: every noun, and every reversed name, with the brands that have it as remedies, in the order of parts."""
    words = F.split("p_name", " ")
    named = table(spark, sf, "part").select(
        "p_partkey", words[1].alias("noun"), F.concat(words[1], F.lit(", "), words[0]).alias("pair"), F.lower("p_brand").alias("brand")
    )
    return (
        named.select(F.posexplode(F.array("noun", "pair")).alias("of", "text"), "brand", "p_partkey")
        .groupBy("text")
        .agg(F.array_sort(F.collect_set("brand")).alias("remedies"), F.min(F.col("p_partkey") * 2 + F.col("of")).alias("term_ord"))
    )


def diseases(spark: SparkSession, sf: str) -> DataFrame:
    """One disease per customer, worded from two parts."""
    part = table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    # The number of parts is one row; the keys below stay within it.
    total = part.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("case_id"),
        ((F.col("c_custkey") * 7) % total).alias("a_key"),
        ((F.col("c_custkey") * 13 + 5) % total).alias("b_key"),
    )
    a = part.select(F.col("p_partkey").alias("a_key"), F.col("w")[0].alias("a_adj"), F.col("w")[1].alias("a_noun"))
    b = part.select(F.col("p_partkey").alias("b_key"), F.col("w")[0].alias("b_adj"), F.col("w")[1].alias("b_noun"))
    hyphened = F.concat(F.substring("a_noun", 1, 2), F.lit("-"), F.expr("substr(a_noun, 3)"))
    worded = F.format_string("%s %ss of the %s %s", "b_adj", "a_noun", "a_adj", "b_noun")
    return (
        customers.join(a, "a_key")
        .join(b, "b_key")
        .select(
            "case_id",
            F.when(F.col("case_id") % 3 == 0, F.concat(F.lit("unnamed "), hyphened)).otherwise(worded).alias("disease"),
        )
    )


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """The event log with its time in milliseconds."""
    return table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", "value", epoch_ms(F.col("ts")).alias("now_ms")
    )
