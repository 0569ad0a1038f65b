"""Shards of nearly equal bytes by a histogram sort, in DataFrame functions only.

Rows are put in one global order and cut where the bytes below come nearest to equal shares. No sample decides: a round
counts, over all partitions, the exact bytes and rows below candidate boundaries inside the cells that still hold a
share's end, and takes the child cell that holds it; when an edge of that cell is within the tolerance, or the cell is
one row, the nearer edge is the splitter. Cells are ranges of the key, ten bits finer in each round, first of the text's digest, then
of the id, then of a number that tells repeated rows apart. So the count of rounds depends on the key's bits, not on the rows,
and a cell of equal texts is cut only if it is too large to lie on one side of a boundary.

With the splitters known the rows are exchanged once. A shard is cut into parts by further splitters of the same
histogram; a part's place in its shard is an exact count, so that slots need only ranks within parts, one task each.

What a round gathers is bounded by the parameters: at most ``shards * MAX_PARTS`` open cells of 1,024 children.

Defined cases: a null text has no bytes and the digest of an empty text. A row's size is its bytes plus one, so that empty
texts are spread as well. Equal texts lie side by side in the order of their ids, nulls first; rows that repeat text and id
follow in any order, and a group of them larger than a shard is cut between rows. Fewer rows than shards leave
shards empty. An empty table gives an empty table. Columns of the input named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrank.llm.frames import table, without
from quillrank.llm.registry import query
from quillrank.sources.shared import materialise

SHARDS = 16
TOLERANCE = 200  # a splitter may miss its share by one 200th of a shard
PART_BYTES = 16_000_000
MAX_PARTS = 256  # of a shard
DIGIT = 10  # bits that a round refines
MASK_32 = (1 << 32) - 1


def text_keys(text: str, doc_id: str | None) -> list[Column]:
    """Digest of the text (60 bits), then the id in two halves: whole numbers from 0, so that no sum leaves 64 bits."""
    value = F.coalesce(F.col(text), F.lit(""))
    keys = [F.conv(F.substring(F.md5(value.cast("binary")), 1, 15), 16, 10).cast("long")]
    if doc_id is not None:
        number = F.col(doc_id).cast("long")
        high = F.shiftright(number, 32) + (1 << 31) + 1
        keys += [F.coalesce(high, F.lit(0)).cast("long"), F.coalesce(number.bitwiseAND(F.lit(MASK_32)), F.lit(0)).cast("long")]
    return keys


def digits(widths: list[int]) -> list[tuple[int, int, int]]:
    """(key, shift, bits) of each round, from the highest bits of the first key to the lowest of the last."""
    found = []
    for key, width in enumerate(widths):
        while width > 0:
            bits = min(DIGIT, width)
            width -= bits
            found.append((key, width, bits))
    return found or [(0, 0, 1)]  # a single row


def splitters(keyed: DataFrame, keys: list[str], widths: list[int], size: str, total: int, shards: int, parts: int) -> DataFrame:
    """(lower bounds of the keys, rows below) of every splitter, for ``shards * parts`` ranges."""
    spark = keyed.sparkSession
    ranges = shards * parts
    edge = [f"c{k}" for k in range(len(keys))]
    j = F.col("j")
    target = j * (total // ranges) + F.expr(f"(j * {total % ranges}L) div {ranges}L")
    slack = F.when(j % parts == 0, total // (shards * TOLERANCE)).otherwise(total // (ranges * 10))
    start = [F.lit(0).cast("long").alias(c) for c in [*edge, "low", "low_rows"]]
    still = spark.range(1, ranges).withColumnRenamed("id", "j").select("j", target.alias("t"), slack.cast("long").alias("slack"), *start)
    found = []
    for key, shift, bits in digits(widths):
        floor = [F.shiftleft(F.shiftright(F.col(k), s), s) for k, s in ((keys[key], shift + bits), (keys[key], shift))]
        parents = [F.col(k) if i < key else floor[0] if i == key else F.lit(0).cast("long") for i, k in enumerate(keys)]
        rows = keyed.select(*[p.alias(c) for p, c in zip(parents, edge, strict=True)], floor[1].alias("child"), F.col(size).alias("b"))
        cells = still.select(*edge, "low", "low_rows").distinct()
        # Bounded by the number of ranges, whatever the rows are.
        counted = rows.join(F.broadcast(cells), edge).groupBy(*edge, "low", "low_rows", "child").agg(F.sum("b").alias("b"), F.count("*").alias("n"))
        below = Window.partitionBy(*edge).orderBy("child").rowsBetween(Window.unboundedPreceding, -1)
        children = counted.select(
            *edge,
            "child",
            "b",
            "n",
            (F.col("low") + F.coalesce(F.sum("b").over(below), F.lit(0))).alias("low"),
            (F.col("low_rows") + F.coalesce(F.sum("n").over(below), F.lit(0))).alias("low_rows"),
        )
        # A share's end lies in the last child that begins at or before it.
        marks = children.select(*edge, F.col("low").alias("at"), F.lit(0).alias("kind"), F.struct("child", "b", "n", "low", "low_rows").alias("cell"))
        marks = marks.unionByName(still.select(*edge, F.col("t").alias("at"), F.lit(1).alias("kind"), "j", "t", "slack"), allowMissingColumns=True)
        so_far = Window.partitionBy(*edge).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = marks.withColumn("cell", F.last("cell", ignorenulls=True).over(so_far)).where("kind = 1")
        cell = F.col("cell")
        before, after = F.col("t") - cell["low"], cell["low"] + cell["b"] - F.col("t")
        judged = placed.select(
            "j",
            "t",
            "slack",
            *[cell["child"].alias(c) if i == key else F.col(c) for i, c in enumerate(edge)],
            cell["low"].alias("low"),
            cell["low_rows"].alias("low_rows"),
            cell["n"].alias("n"),
            (before > after).alias("upper"),
            ((F.least(before, after) <= F.col("slack")) | (cell["n"] == 1)).alias("met"),
        )
        judged = materialise(judged, "splitters")
        bounds = [F.col(c) + F.when(F.col("upper"), 1 << shift).otherwise(0) if i == key else F.col(c) for i, c in enumerate(edge)]
        rows_below = F.col("low_rows") + F.when(F.col("upper"), F.col("n")).otherwise(0)
        found.append(judged.where("met").select(*[b.cast("long").alias(c) for b, c in zip(bounds, edge, strict=True)], rows_below.alias("rows_below")))
        still = judged.where("NOT met").select("j", "t", "slack", *edge, "low", "low_rows")
        if not still.head(1):
            break
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return materialise(every, "splitters")


def histogram_sort(frame: DataFrame, keys: list[Column], size: Column, shards: int = SHARDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows with ``shard``, ``part`` (of the shard) and ``slot`` (place in the shard, from 0), in partitions of one part each.

    ``keys``: whole numbers from 0 to below 2**62, the first the most significant. ``size``: bytes of a row, at least 1.
    """
    names = [f"_key{k}" for k in range(len(keys) + 1)]
    made = {**dict(zip(names, keys, strict=False)), "_size": size.cast("long")}
    frame = frame.select(*[F.col(f"`{c}`") for c in frame.columns], *[e.alias(n) for n, e in made.items()])
    frame = without(frame, ["shard", "part", "slot"])
    # Written once: repeated rows keep their numbers in all rounds, and no round computes the input again.
    keyed = materialise(frame.withColumn(names[-1], F.monotonically_increasing_id()), "keyed")
    facts = keyed.agg(F.sum("_size").alias("total"), *[F.struct(F.min(k), F.max(k)).alias(k) for k in names]).first()
    total = facts["total"] or 0
    if not total:
        nothing = [F.lit(0).cast("int").alias("shard"), F.lit(0).cast("int").alias("part"), F.lit(0).cast("long").alias("slot")]
        return keyed.drop(*names, "_size").select("*", *nothing)
    # Bits that all rows share need no round.
    keyed = keyed.withColumns({k: F.col(k) - F.lit(facts[k][0]).cast("long") for k in names})
    widths = [int(facts[k][1] - facts[k][0]).bit_length() for k in names]
    parts = min(MAX_PARTS, -(-total // (shards * part_bytes)))
    ranges = shards * parts
    if ranges > 1:
        cuts = splitters(keyed, names, widths, "_size", total, shards, parts)
        edges = F.sort_array(F.collect_list(F.struct(*[f"c{k}" for k in range(len(names))], "rows_below")))
        cuts = cuts.agg(edges.alias("cuts")).select("cuts").scalar()
    else:
        kind = ", ".join(f"c{k}: bigint" for k in range(len(names)))
        cuts = F.array().cast(f"array<struct<{kind}, rows_below: bigint>>")
    powers = [1 << k for k in reversed(range(max(1, (ranges - 1).bit_length())))]

    def place(cuts: Column) -> Column:
        """How many splitters are at or below the row's key, by halving."""
        own = F.struct(*names, F.lit((1 << 63) - 1))

        def step(at: Column, power: Column) -> Column:
            return at + F.when(F.coalesce(F.get(cuts, at + power - 1) <= own, F.lit(False)), power).otherwise(0)

        return F.aggregate(F.array(*[F.lit(p) for p in powers]), F.lit(0), step)

    def first_row(cuts: Column, at: Column) -> Column:
        return F.coalesce(F.get(cuts, at - 1)["rows_below"], F.lit(0))

    placed = keyed.withColumn("_cuts", cuts).withColumn("_range", place(F.col("_cuts")))
    placed = placed.withColumn("shard", F.floor(F.col("_range") / parts).cast("int"))
    placed = placed.withColumn("_first", first_row(F.col("_cuts"), F.col("_range")) - first_row(F.col("_cuts"), F.col("shard") * parts)).drop("_cuts")
    dealt = placed.repartitionById(ranges, F.col("_range"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*names))
    dealt = dealt.withColumn("slot", F.col("_first") + rank - 1).withColumn("part", (F.col("_range") - F.col("shard") * parts).cast("int"))
    return dealt.drop(*names, "_size", "_range", "_first")


def text_bytes(text: str) -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1


def shard_texts(docs: DataFrame, text: str = "text", doc_id: str | None = "doc_id", shards: int = SHARDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """Documents with shard, part and slot; equal texts side by side, shards of nearly equal bytes."""
    return histogram_sort(docs, text_keys(text, doc_id), text_bytes(text), shards, part_bytes)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, files in the order of the slots. The rows are in place already: nothing is shuffled."""
    sharded.write.partitionBy("shard").parquet(path)


SQL = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([CAST(i AS UBIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, b: CASE WHEN (a & 1) = 1 THEN xor(CAST(3988292384 AS UBIGINT), a >> 1) ELSE a >> 1 END)) AS t),
base AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, hex(coalesce(text, '')) AS h,
         CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS k FROM documents),
crcs AS (
  SELECT doc_id, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT),
      list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS UBIGINT))),
    lambda c, x: xor(c >> 8, t[CAST(1 + (xor(c, x) & 255) AS BIGINT)])), CAST(4294967295 AS UBIGINT)) AS BIGINT) AS text_crc32
  FROM base, crc_table),
facts AS (
  SELECT CAST(sum(size) AS BIGINT) AS total, min(k) AS k0, min(doc_id) AS d0,
         length(bin(max(k) - min(k))) AS kw, length(bin(max(doc_id) - min(doc_id))) AS dw FROM base),
placed AS (
  SELECT doc_id, size, k - k0 AS k, doc_id - d0 AS d,
         CAST(sum(size) OVER (ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS below FROM base, facts),
levels AS (
  SELECT l, greatest(kw - 10 * l, 0) AS ks, 63 AS ds FROM facts, unnest(range(1, (kw + 9) // 10 + 1)) AS r(l)
  UNION ALL
  SELECT (kw + 9) // 10 + l, 0, greatest(dw - 10 * l, 0) FROM facts, unnest(range(1, (dw + 9) // 10 + 1)) AS r(l)),
targets AS (SELECT j, CAST(j AS BIGINT) * total // 16 AS t, total // 3200 AS slack FROM facts, unnest(range(1, 16)) AS r(j)),
owners AS (SELECT j, t, slack, k, d FROM targets JOIN placed ON below <= t AND t < below + size),
cells AS (
  SELECT j, l, t, slack, min(p.below) AS low, min(p.below) + sum(p.size) AS high, count(*) AS n
  FROM owners o, levels v, placed p
  WHERE (p.k >> v.ks) = (o.k >> v.ks) AND (v.ds = 63 OR (p.d >> v.ds) = (o.d >> v.ds)) GROUP BY j, l, t, slack),
cuts AS (
  SELECT j, arg_min(CASE WHEN t - low > high - t THEN high ELSE low END, l) AS cut FROM cells
  WHERE least(t - low, high - t) <= slack OR n = 1 GROUP BY j),
sharded AS (SELECT doc_id, size, below, CAST((SELECT count(*) FROM cuts WHERE cut <= below) AS INTEGER) AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY below) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM sharded JOIN crcs USING (doc_id)
"""


@query("op11_histogram_sort", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # Only digests and sizes are put in order here; the texts themselves stay where they are.
    digests = docs.select(
        "doc_id",
        text_bytes("text").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        *[key.alias(f"key{k}") for k, key in enumerate(text_keys("text", "doc_id"))],
    )
    keys = [F.col(f"key{k}") for k in range(3)]
    return histogram_sort(digests, keys, F.col("size")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
