"""A corpus from raw documents, in stages that are each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. The columns of ``documents``
stay the same up to the last stage, which returns token ids in the place of the text, the digest of what they decode to, and whether
that is the text. Rows with a null or empty text are no
text in any language and leave at the first stage. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm.decontaminate import decontaminate
from quillrank.llm.frames import small_enough, table
from quillrank.llm.language import identify
from quillrank.llm.parity_join import near_duplicates
from quillrank.llm.pieces import encode
from quillrank.llm.recompression import dedup_substrings
from quillrank.sources.shared import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts that read as one of the languages of the labelled rows; all rows with a language are labelled."""
    labelled = docs.where(F.col("lang").isNotNull())
    return identify(docs.select(COLUMNS), labelled).where("readable").select(COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies (five words, 0.8) the document with the smallest id, once."""
    grouped = near_duplicates(docs.select(COLUMNS), words=5, percent=80)
    kept = grouped.where(F.col("component_id").isNull() | (F.col("component_id") == F.col("doc_id"))).select(COLUMNS)
    # Rows that repeat an id are few or none; only they are gathered by id.
    again = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    again = small_enough(materialise(again, "repeated"))
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(again, "doc_id", "left_anti").unionByName(once).select(COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that an earlier document has; texts of which nothing is left go."""
    cut = dedup_substrings(docs.select(COLUMNS)).where((F.col("n_removed") < F.col("n_words")) | (F.col("n_words") == 0))
    return cut.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten words in a row of a benchmark item."""
    return decontaminate(docs.select(COLUMNS), table(spark, sf_dir, "benchmark")).where("n_hit = 0").select(COLUMNS)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts, decoded again: the decoded text's digest, and whether it is the text (the word mark ``▁`` being a blank)."""
    whole = encode(docs.select(COLUMNS), decoded=True)
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), "▁", " ")
    digest = F.sha2(F.col("decoded").cast("binary"), 256)
    return whole.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", digest.alias("text_sha256"), same.alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("piece_encoding", piece_encoding),
]

ORACLE_SQL: str | None = None  # language models and token ids are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
