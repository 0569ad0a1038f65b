"""A stored BM25 index in segments, searched block by block.

A segment deals the passages of each collection to parts of about ``PART`` passages. Its ``docs`` hold each passage's distinct words and
how often it has each; its blocks hold the same by term: the postings of one term in one part, with about equal weights, each with the
greatest term frequency and the least length in it. From these follows the most that a posting of the block can weigh, whatever the
collection's mean length is by now; so a search reads headers first and the postings only of blocks that can still matter. Passages go to
their part whole and are turned into blocks there, and blocks go to their part whole and are added up there: no posting and no partial
score is a row of a shuffle. A common term is many blocks, in as many tasks as there are parts.

Passages are added as further segments. Removals are kept beside them, with how often each term went, so that the
statistics are those of what is left; ``merge`` makes one segment of all. What counts is listed in a manifest of its own version,
written last: a change that stops before it has no effect.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillrank.operators.bm25 import B, K1, SCORE_DIGITS, SEED_PASSAGES, best_of_postings, counted, query_terms
from quillrank.operators.ordered import fixed_point, top_k
from quillrank.sources.shared import materialise, path_exists

PART = 8_192
QUERY_BLOCK = 4_096
LEVELS = 8  # of weight, by which the postings of a term are put in blocks
CELL = ["segment", "book_ord", "part"]
PLACE = [*CELL, "term", "level"]


def weight(tf: Column, length: Column, mean: Column) -> Column:
    frequency = tf.cast("double")
    return frequency * F.lit(K1 + 1) / (frequency + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / mean))


def blocks_of(target: pa.Schema):
    """Kernel: the passages of one part (book_ord, part, id, len, terms, tfs, mean) -> its blocks, by term and level."""

    def kernel(items: pa.Table) -> pa.Table:
        items = items.take(pc.sort_indices(items, sort_keys=[("id", "ascending")]))
        words = items.column("terms").combine_chunks()
        coded = words.flatten().dictionary_encode()
        item = pc.list_parent_indices(words).to_numpy()
        tf = items.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
        length = items.column("len").to_numpy()[item]
        by_term = np.argsort(pc.sort_indices(coded.dictionary).to_numpy())
        weights = tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * length / items.column("mean")[0].as_py()))
        level = np.floor(LEVELS * weights / (K1 + 1)).astype(np.int64)
        key = by_term[coded.indices.to_numpy()] * (LEVELS + 1) + level
        order = np.argsort(key, kind="stable")  # of a block's postings: by id
        key, tf, length, item = key[order], tf[order], length[order], item[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        ends = np.append(starts, len(key))
        fields = [items.column("id").combine_chunks().take(pa.array(item)), pa.array(tf), pa.array(length)]
        columns = {
            "book_ord": items.column("book_ord").combine_chunks().take(pa.array(np.zeros(len(starts), np.int64))),
            "part": items.column("part").combine_chunks().take(pa.array(np.zeros(len(starts), np.int64))),
            "term": coded.dictionary.take(coded.indices.take(pa.array(order[starts]))),
            "level": pa.array(level[order[starts]]),
            "n": pa.array(np.diff(ends)),
            "top_tf": pa.array(np.maximum.reduceat(tf, starts)),
            "least_len": pa.array(np.minimum.reduceat(length, starts)),
            "postings": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays(fields, ["id", "tf", "len"])),
        }
        return pa.table([columns[name] for name in target.names], names=target.names).cast(target)

    return kernel


def best_of_part(target: pa.Schema, k: int):
    """Kernel: queries (terms, idfs) and blocks of one part, where removed ids are a block without a term -> each query's ``k`` best passages."""

    def kernel(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        if not asked.num_rows or not blocks.num_rows:
            return target.empty_table()
        removed = pc.is_null(blocks.column("term"))
        gone = pc.list_flatten(blocks.filter(removed).column("postings").combine_chunks()).field("id")
        blocks = blocks.filter(pc.invert(removed))
        lists = blocks.column("postings").combine_chunks()
        found = lists.flatten()
        if not len(found):
            return target.empty_table()
        known = asked.column("terms").combine_chunks().flatten().unique()
        codes = pc.index_in(blocks.column("term").combine_chunks(), value_set=known).fill_null(-1).to_numpy()
        codes = codes[pc.list_parent_indices(lists).to_numpy()]
        ids = found.field("id").unique()
        ids = ids.take(pc.sort_indices(ids))  # in the order of ties
        item = pc.index_in(found.field("id"), value_set=ids).to_numpy()
        stays = ~pc.is_in(ids, value_set=gone).to_numpy(zero_copy_only=False)
        held = np.flatnonzero(stays[item] & (codes >= 0))
        tf, length = found.field("tf").to_numpy()[held], found.field("len").to_numpy()[held]
        best = best_of_postings(asked, known, codes[held], item[held], tf, length, k)
        if not best:
            return target.empty_table()
        query, item, total = (np.concatenate(column) for column in zip(*best, strict=True))
        columns = {
            "query_id": asked.column("query_id").take(pa.array(query)),
            "book_ord": asked.column("book_ord").take(pa.array(query)),
            "segment": blocks.column("segment").take(pa.array(np.zeros(len(query), np.int64))),
            "id": ids.take(pa.array(item)),
            "points": pa.array(total),
        }
        return pa.table([columns[name] for name in target.names], names=target.names).cast(target)

    return kernel


class Index:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # What there is ---------------------------------------------------------------------------------

    def version(self) -> int:
        version = 0
        while path_exists(self.spark, f"{self.folder}/manifest/{version + 1}/_SUCCESS"):
            version += 1
        return version

    def manifest(self) -> list[tuple[str, str]]:
        """(name, kind) of the parts that count: segments and removals."""
        version = self.version()
        if not version:
            return []
        rows = self.spark.read.parquet(f"{self.folder}/manifest/{version}").collect()
        return sorted((row["name"], row["kind"]) for row in rows)

    def _commit(self, parts: list[tuple[str, str]]) -> None:
        rows = self.spark.createDataFrame(parts, "name string, kind string").coalesce(1)
        rows.write.mode("overwrite").parquet(f"{self.folder}/manifest/{self.version() + 1}")

    def _read(self, kind: str, table: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{kind}/{name}/{table}" for name, of in self.manifest() if of == kind]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _id_type(self) -> str:
        name = next((name for name, kind in self.manifest() if kind == "segment"), None)
        return "string" if name is None else dict(self.spark.read.parquet(f"{self.folder}/segment/{name}/docs").dtypes)["id"]

    def blocks(self) -> DataFrame:
        kind = self._id_type()
        header = "segment string, book_ord long, term string, level int, part int, n long, top_tf long, least_len long"
        return self._read("segment", "blocks", f"{header}, postings array<struct<id: {kind}, tf: bigint, len: bigint>>")

    def _every_doc(self) -> DataFrame:
        kept = "book_id string, subject string, len long, terms array<string>, tfs array<int>"
        return self._read("segment", "docs", f"segment string, book_ord long, part int, id {self._id_type()}, {kept}")

    def docs(self) -> DataFrame:
        return self._every_doc().join(self.removed().drop("part", "len"), ["segment", "book_ord", "id"], "left_anti")

    def removed(self) -> DataFrame:
        return self._read("removal", "docs", f"segment string, book_ord long, part int, id {self._id_type()}, len long")

    def stats(self) -> DataFrame:
        """(book_ord, all, mean): how many passages are left of each collection and their mean length."""
        signed = self._every_doc().select("book_ord", "len", F.lit(1).alias("sign")).unionByName(self.removed().select("book_ord", "len", F.lit(-1).alias("sign")))
        sums = signed.groupBy("book_ord").agg(
            F.sum("sign").alias("all"), F.sum(F.col("len") * F.col("sign")).alias("words"), F.sum(F.when(F.col("len").isNotNull(), F.col("sign"))).alias("sized")
        )
        return sums.where("all > 0").select("book_ord", "all", F.try_divide("words", "sized").alias("mean"))

    def term_counts(self, terms: DataFrame) -> DataFrame:
        """(book_ord, term, df) of what is left, for the given terms."""
        counts = self.blocks().select("book_ord", "term", "n")
        gone = self._read("removal", "terms", "book_ord long, term string, n long").select("book_ord", "term", (-F.col("n")).alias("n"))
        found = counts.unionByName(gone).join(terms, "term", "left_semi")
        return found.groupBy("book_ord", "term").agg(F.sum("n").alias("df")).where("df > 0")

    # Changes ---------------------------------------------------------------------------------------

    def add(self, passages: DataFrame) -> None:
        """Passages (book_ord, id, book_id, subject, content) as a segment. Those of the same id that there are already go."""
        keys = ["book_ord", "id"]
        if any(kind == "segment" for _, kind in self.manifest()):
            self.remove(passages.select(*keys))
        name = uuid.uuid4().hex
        self._write(name, passages.select("book_ord"), counted(passages))
        self._commit([*self.manifest(), (name, "segment")])

    def _write(self, name: str, keys: DataFrame, docs: DataFrame) -> None:
        """Counted passages as a segment; ``keys`` has the collection of each."""
        path = f"{self.folder}/segment/{name}"
        parts = materialise(keys.groupBy("book_ord").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")), "parts")
        part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")
        dealt = docs.join(parts, "book_ord", "left").select(
            F.lit(name).alias("segment"), F.col("book_ord").cast("long"), part.alias("part"), "id", "book_id", "subject", "len", "terms", "tfs"
        )
        dealt.write.mode("overwrite").parquet(f"{path}/docs")
        written = self.spark.read.schema(dealt.schema).parquet(f"{path}/docs")
        mean = materialise(written.groupBy("book_ord").agg(F.avg("len").alias("mean")), "means")
        items = written.where(F.size("terms") > 0).select("book_ord", "part", "id", "len", "terms", "tfs").join(mean, "book_ord")
        posting = T.StructType([written.schema["id"], T.StructField("tf", T.LongType()), T.StructField("len", T.LongType())])
        schema = T.StructType([
            written.schema["book_ord"],
            T.StructField("part", T.IntegerType()),
            T.StructField("term", T.StringType()),
            T.StructField("level", T.IntegerType()),
            *(T.StructField(of, T.LongType()) for of in ("n", "top_tf", "least_len")),
            T.StructField("postings", T.ArrayType(posting)),
        ])
        blocks = items.groupBy("book_ord", "part").applyInArrow(blocks_of(to_arrow_schema(schema)), schema)
        blocks.withColumn("segment", F.lit(name)).write.mode("overwrite").parquet(f"{path}/blocks")

    def remove(self, keys: DataFrame) -> None:
        """Passages (book_ord, id) go; those that are not there are passed over."""
        name = uuid.uuid4().hex
        path = f"{self.folder}/removal/{name}"
        gone = self.docs().select(*CELL, "id", "len").join(keys, ["book_ord", "id"], "left_semi").select(*CELL, "id", "len")
        gone = materialise(gone, "gone")
        if not gone.head(1):
            return
        gone.write.mode("overwrite").parquet(f"{path}/docs")
        lost = self._every_doc().select("segment", "book_ord", "id", "terms").join(gone, ["segment", "book_ord", "id"], "left_semi")
        lost = lost.select("book_ord", F.explode("terms").alias("term"))
        lost.groupBy("book_ord", "term").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/terms")
        self._commit([*self.manifest(), (name, "removal")])

    def merge(self) -> None:
        """One segment of all that is left."""
        name = uuid.uuid4().hex
        left = self.docs()
        self._write(name, left.select("book_ord"), left.drop("segment", "part"))
        self._commit([(name, "segment")])

    # Search ----------------------------------------------------------------------------------------

    def search(self, queries: DataFrame, k: int, rank: str = "pos") -> DataFrame:
        """Each query's best ``k`` passages of every collection; ties by id.

        1. The passages of a query's rarest terms are scored; their k-th best is a bound that every result reaches.
        2. Terms that cannot reach it together fetch no passages. Of the others, a block is read only if its greatest
           weight and the most that all other terms add reach the bound. Passages that are missed stay below it.
        3. The blocks that are read, and those of the remaining terms, meet the queries part by part; a task adds scores up in
           memory and returns only the ``k`` best of its part for each query.
        """
        pair = ["query_id", "book_ord"]
        terms = materialise(query_terms(queries), "query-terms")
        asked_for = terms.select("term").distinct()
        stats = materialise(self.stats(), "stats")
        counts = self.term_counts(asked_for).join(stats, "book_ord")
        idf = F.log(F.lit(1.0) + (F.col("all") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
        counts = materialise(counts.select("book_ord", "term", "df", idf.alias("idf"), "mean"), "counts")
        headers = self.blocks().select(*PLACE, "top_tf", "least_len").join(counts, ["book_ord", "term"])
        best = fixed_point(weight(F.col("top_tf"), F.col("least_len"), F.col("mean")) * F.col("idf"), SCORE_DIGITS)
        headers = materialise(headers.select(*PLACE, best.alias("block_most")), "headers")
        most = headers.groupBy("book_ord", "term").agg(F.max("block_most").alias("most"))
        rare = Window.partitionBy(*pair).orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
        light = Window.partitionBy(*pair).orderBy("most", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # A query has as many rows here as it has distinct terms.
        ordered = terms.join(counts, "term").join(most, ["book_ord", "term"])
        ordered = ordered.withColumn("seen", F.coalesce(F.sum("df").over(rare), F.lit(0))).withColumn("light", F.sum("most").over(light))
        ordered = materialise(ordered.withColumn("whole", F.sum("most").over(Window.partitionBy(*pair))), "asked")
        # One row: how many queries there are decides the number of their blocks.
        query_blocks = max(1, -(-terms.select("query_id").distinct().count() // QUERY_BLOCK))

        def scored(wanted: DataFrame, read: DataFrame) -> DataFrame:
            """(pair, segment, id, points) of the ``k`` best of each part by the asked terms in the blocks ``read``."""
            gathered = wanted.groupBy(*pair).agg(F.collect_list(F.struct("term", "idf")).alias("t"), F.first("mean").alias("mean_len"))
            asked = gathered.select(*pair, "mean_len", F.col("t.term").alias("terms"), F.col("t.idf").alias("idfs"))
            cells = materialise(read.select(*CELL).distinct(), "cells")
            left = materialise(asked, "queries").join(cells, "book_ord").withColumn("_col", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int"))
            blocks = self.blocks()
            held = blocks.join(read, PLACE, "left_semi").select(*CELL, "term", "postings")
            gone = F.array(F.struct("id", F.lit(0).cast("long").alias("tf"), F.lit(0).cast("long").alias("len")))
            gone = self.removed().join(cells, CELL, "left_semi").select(*CELL, F.lit(None).cast("string").alias("term"), gone.alias("postings"))
            right = held.unionByName(gone).withColumn("_col", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
            id_field = T.StructField("id", blocks.schema["postings"].dataType.elementType["id"].dataType)
            schema = T.StructType([asked.schema["query_id"], asked.schema["book_ord"], cells.schema["segment"], id_field, T.StructField("points", T.LongType())])
            met = best_of_part(to_arrow_schema(schema), k)
            return left.groupBy(*CELL, "_col").cogroup(right.groupBy(*CELL, "_col")).applyInArrow(met, schema)

        seeds = ordered.where(F.col("seen") < SEED_PASSAGES * k)
        seeded = scored(seeds, headers.join(seeds.select("book_ord", "term").distinct(), ["book_ord", "term"], "left_semi").select(*PLACE))
        bounds = top_k(seeded, pair, [F.col("points").desc()], k, "_place").where(F.col("_place") == k).select(*pair, F.col("points").alias("bound"))
        judged = ordered.join(bounds, pair, "left").withColumn("bound", F.coalesce("bound", F.lit(-1).cast("long")))
        judged = materialise(judged.withColumn("essential", F.col("light") >= F.col("bound")), "judged")

        # Of all queries that ask for a term, the one that is content with least decides what is read.
        least = judged.where("essential").groupBy("book_ord", "term").agg(F.min(F.col("bound") - F.col("whole") + F.col("most")).alias("least"))
        reach = headers.join(least, ["book_ord", "term"]).where(F.col("block_most") >= F.col("least"))
        self.read_blocks = materialise(reach.select(*PLACE), "read")  # what the last search read to find passages
        others = judged.where(~F.col("essential")).select("book_ord", "term").distinct()
        rest = headers.join(others, ["book_ord", "term"], "left_semi").select(*PLACE)
        read = materialise(self.read_blocks.unionByName(rest).distinct(), "read-all")
        best = top_k(scored(judged, read), pair, [F.col("points").desc(), F.col("id").asc()], k, rank)
        best = materialise(best.withColumn("score", F.col("points") / F.lit(10.0**SCORE_DIGITS)).drop("points"), "sparse")
        keys = ["segment", "book_ord", "id"]
        return best.join(self._every_doc().select(*keys, "book_id", "subject"), keys).drop("segment")
