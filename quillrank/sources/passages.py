"""Reading passages, rubrics, terms and vectors, and the checks of their shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions.paths import citation_id, section_title


def write_passages(passages: DataFrame, path: str) -> None:
    """One partition directory per book, so that a book's reads skip the others."""
    passages.write.mode("overwrite").partitionBy("book_id").parquet(path)


def read_passages(spark: SparkSession, path: str, books: list[str] | None = None) -> DataFrame:
    """All passages, or those of some books; the filter prunes partitions."""
    frame = spark.read.parquet(path)
    return frame if books is None else frame.filter(F.col("book_id").isin(books))


def passage_source(score: Column | None = None) -> list[Column]:
    """A passage's columns as a source row."""
    return [
        F.col("chunk_id"),
        F.col("book_id"),
        F.col("source_title").alias("book_title"),
        F.col("author"),
        F.col("remedy").alias("remedy_name"),
        section_title(F.col("section_group"), F.col("sections"), F.col("aphorisms")).alias("section_title"),
        F.array("chunk_index").alias("passage_indexes"),
        F.col("content").alias("text"),
        (F.col("score") if score is None else score).alias("score"),
    ]


TEXTS = ["chunk_id", "source_title", "content"]
INTEGERS = ["chunk_index"]


def payload_problem(texts: list[str], integers: list[str]) -> Column:
    """What a winner's payload lacks of what a source needs; NULL if nothing. A number serves as a text."""
    tests = [F.when(F.col(name).isNull(), F.lit(f"no {name}")) for name in texts]
    tests += [F.when(F.col(name).try_cast("bigint").isNull() | (F.col(name).try_cast("double") != F.col(name).try_cast("bigint")), F.lit(f"no integer {name}")) for name in integers]
    return F.coalesce(*tests, F.lit(None).cast("string"))


def judged(passages: DataFrame) -> DataFrame:
    """Payloads with ``_problem``: NULL if nothing of one is there, empty if it can be used. It is told where they are read, so that no text is carried only to be looked at."""
    texts, integers = ([name for name in names if name in passages.columns] for names in (TEXTS, INTEGERS))
    absent = F.coalesce(*[F.col(name).cast("string") for name in [*texts, *integers]]).isNull()
    return passages.withColumn("_problem", F.when(~absent, F.coalesce(payload_problem(texts, integers), F.lit(""))))


def checked(found: DataFrame) -> DataFrame:
    """Winners whose payload can be used; any other is an error. Only fields that were read are looked at."""
    passage = F.concat(F.lit("passage "), F.col("book_id"), F.lit("/"), F.col("id").cast("string"))
    problem = F.col("_problem")
    message = F.when(problem.isNull(), F.concat(F.lit("no payload for "), passage)).otherwise(F.concat(F.lit("payload of "), passage, F.lit(" has "), problem))
    first = next(name for name in TEXTS if name in found.columns)
    usable = problem.isNotNull() & (problem == "")
    return found.withColumn(first, F.when(~usable, F.raise_error(message)).otherwise(F.col(first))).drop("_problem")


def fetch_payloads(best: DataFrame, passages: DataFrame, strict: bool = True) -> DataFrame:
    """The payload of the winners only. A winner without one, or with one that is not whole, is an error, or NULL if not strict.

    Passages are first cut to the winners: when those are few, their keys go to the passages, and no
    text is shuffled but that of the winners. Give ``best`` as a table, so that its size is known.
    """
    keys = ["book_id", "id"]
    payloads = judged(passages) if strict else passages
    found = best.join(payloads.join(best.select(keys).distinct(), keys, "left_semi"), keys, "left")
    return checked(found) if strict else found


def payload_bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("book_id", "id"), F.lit(buckets)).cast("int")


def store_payloads(passages: DataFrame, path: str, buckets: int = 256) -> None:
    """Payloads in folders by hash of (book, id), sorted within, without their vectors."""
    stored = passages.drop("embedding").withColumn("bucket", payload_bucket(buckets))
    # A range of buckets for each task; a large bucket is several files.
    stored = stored.repartitionByRange("bucket", "book_id", "id").sortWithinPartitions("bucket", "book_id", "id")
    stored.write.mode("overwrite").partitionBy("bucket").parquet(path)


def fetch_stored(best: DataFrame, path: str, buckets: int = 256, strict: bool = True) -> DataFrame:
    """``fetch_payloads`` from ``store_payloads``: the winners' buckets prune the folders that are read, and no payload is shuffled.

    Winners are a search's limit for each query. If even their keys are too many for a broadcast, Spark shuffles both sides.
    """
    keyed = best.withColumn("bucket", payload_bucket(buckets))
    wanted = keyed.select("bucket", "book_id", "id").distinct()
    # At most ``buckets`` small numbers, by which whole folders are left out before anything is read.
    numbers = sorted(row["bucket"] for row in wanted.select("bucket").distinct().collect())
    stored = best.sparkSession.read.parquet(path).where(F.col("bucket").isin(numbers))
    payloads = (judged(stored) if strict else stored).join(wanted, ["bucket", "book_id", "id"])
    found = best.join(payloads.drop("bucket"), ["book_id", "id"], "left")
    return checked(found) if strict else found


def missing_collections(expected: DataFrame, passages: DataFrame) -> DataFrame:
    """Expected collections that hold no passage."""
    present = passages.select("book_id").distinct()
    return expected.join(present, "book_id", "left_anti")


def check_required(raw: DataFrame, texts: list[str], integers: list[str]) -> DataFrame:
    """``problem``: the first required field that is missing or of the wrong kind, else NULL.

    Fields are strings as read. Any text or number serves as a text; an integer must be one.
    """
    tests = [F.when(F.col(name).isNull(), F.lit(f"no {name}")) for name in texts]
    whole = r"^[+-]?\d+\z"
    tests += [
        F.when(F.col(name).isNull() | ~F.col(name).rlike(whole), F.lit(f"no integer {name}")) for name in integers
    ]
    return raw.withColumn("problem", F.coalesce(*tests))


def attach_embeddings(texts: DataFrame, vectors: DataFrame, keys: list[str], dimensions: int) -> DataFrame:
    """Each text with its vector, matched by key; ``problem`` names a vector that cannot be used."""
    found = texts.join(vectors, keys, "left")
    numeric = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))
    problem = (
        F.when(F.col("embedding").isNull(), F.lit("no embedding"))
        .when(F.size("embedding") != dimensions, F.lit("wrong dimensions"))
        .when(~numeric, F.lit("not numeric"))
    )
    return found.withColumn("problem", problem)


def citations(sources: DataFrame, corpus: str = "corpus") -> DataFrame:
    """Sources as citations: identified by corpus, book and passage, without the score."""
    return sources.withColumn("id", citation_id(corpus, F.col("book_id"), F.col("chunk_id"))).drop("score", "chunk_id")


def oversize_queries(sources: DataFrame, max_chars: int) -> DataFrame:
    """Per query, whether any source's text is too long to be used."""
    return sources.groupBy("query_id").agg(
        F.max(F.length("text")).cast("long").alias("longest"),
        F.bool_or(F.length("text") > max_chars).alias("rejected"),
    )


def rubric_problems(rubrics: DataFrame) -> DataFrame:
    """``problem``: why a rubric's record cannot be used, else NULL. Only fields that were read are looked at."""
    unnamed = F.lit(False)
    for name in ("id", "chapter", "text"):
        unnamed = unnamed | F.col(name).isNull() if name in rubrics.columns else unnamed
    graded = F.forall("remedies", lambda r: r["remedy_id"].isNotNull() & r["grade"].isNotNull())
    return rubrics.withColumn(
        "problem",
        F.when(unnamed, F.lit("no text"))
        .when(F.col("remedies").isNull(), F.lit("no remedies"))
        .when(~graded, F.lit("no grade")),
    )


def listed_remedies(rubrics: DataFrame) -> DataFrame:
    """(book_id, rubric_id, listed_ord, remedy_id, grade) of rubrics; one whose record is not whole is an error when it is read.

    The outer explode keeps Spark from testing the remedies, and so the error, before the rubrics are cut to those asked for.
    """
    each = rubric_problems(rubrics).select("book_id", F.col("id").alias("rubric_id"), "problem", F.posexplode_outer("remedies").alias("listed_ord", "remedy"))
    each = each.where(F.col("problem").isNotNull() | F.col("remedy").isNotNull())
    message = F.concat(F.lit("rubric "), F.coalesce(F.col("rubric_id").cast("string"), F.lit("?")), F.lit(": "), F.col("problem"))
    remedy = F.when(F.col("problem").isNotNull(), F.raise_error(message)).otherwise(F.col("remedy.remedy_id"))
    return each.select("book_id", "rubric_id", "listed_ord", remedy.alias("remedy_id"), F.col("remedy.grade").alias("grade"))


def catalog_of(terms: DataFrame) -> DataFrame:
    """Clinical terms (text, remedies) that can be used; an empty catalog or a term without text or remedies is an error."""
    if not terms.head(1):
        raise ValueError("there are no clinical terms")
    broken = F.col("text").isNull() | F.col("remedies").isNull() | F.exists("remedies", lambda r: r.isNull())
    return terms.withColumn("text", F.when(broken, F.raise_error(F.lit("invalid clinical term"))).otherwise(F.col("text")))


def term_records(stored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Stored terms (path, pairs of remedy and grade) as (text, remedies)."""
    return stored.select(
        *(keys or []),
        F.array_join("path", ", ").alias("text"),
        F.transform("pairs", lambda p: p["remedy_id"]).alias("remedies"),
    )
