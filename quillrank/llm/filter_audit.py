"""How filters interact, counted by an incremental stream that takes back what later files prove wrong.

1. ``narrow``: of each row its part, the text's digest and a mask, one bit for each filter that the text fails by
   itself. One pass over the text, in array and string functions.
2. ``Audit``: the files come as available-now micro-batches. Whether a text repeats one of a smaller id depends on all
   files, so the state keeps, by text, the rows of the smallest id so far (the holders). Every row is first counted as
   a repetition; a holder's count is moved to its own mask. When a smaller id of the same text arrives later, the
   earlier holder's mask is taken back from the counters of its part and added again as a repetition.
3. ``interactions``: the counters of the stream, a few for each mask and part, are spread over all orders of filters.

State and counters are tables in the shared folder, one folder for each micro-batch, written in full before the batch
is committed; a batch that runs again after a failure reads only earlier folders and writes its own anew. No row of the
state is rewritten: a key's holders are those of the smallest id in all folders.

A text that very many rows repeat is no hot key: rows are first counted by (text, id), so equal rows are one, smallest ids are
taken before the shuffle, and holders are found by a join on (text, id). Texts are told apart by 128-bit MD5.

Defined cases: a null text is the empty text; a null part is an empty string. A row without an id neither repeats
another nor is repeated. Rows that repeat both text and the smallest id all hold it, so none of them fails. Labels of
one id that differ count with their largest values; without a label both are 0. An empty table has no part and
gives no row. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm.frames import table
from quillrank.llm.registry import query
from quillrank.sources.shared import materialise, shared_folder

FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_CAPITALS_PERCENT = 10
SYMBOLS = "[#$%&*|]"
SPACES = " \t\n\x0b\x0c\r"
REPEATED = 1 << FILTERS.index("E")
BATCHES = 4  # micro-batches that the files are dealt out to, about

ROW = ["key", "doc_id", "part", "mask"]
LABELLED = [*ROW, "good", "toxic", "n"]
COUNTER = ["part", "mask", "good", "toxic"]


def own_mask(text: Column) -> Column:
    """One bit for each of the filters A to D that a text fails."""
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))
    # As the variable of a lambda the words are split once for both counts.
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")))
    counted = F.get(counts, F.lit(0))

    def bits(w: Column) -> Column:
        failed = [
            w["all"] < MIN_WORDS,
            100 * w["distinct"].cast("long") < MIN_DISTINCT_PERCENT * w["all"].cast("long"),
            100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MAX_CAPITALS_PERCENT * F.length(text).cast("long"),
            text.rlike(SYMBOLS),
        ]
        return sum((F.when(bit, 1 << k).otherwise(0) for k, bit in enumerate(failed)), F.lit(0))

    return F.get(F.transform(F.array(counted), bits), F.lit(0))


def narrow(docs: DataFrame, text: str = "text", part: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """(key, doc_id, part, mask, n): the distinct rows of a table, how often each is there, and what it fails by itself."""
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.unhex(F.md5(value.cast("binary"))).alias("key"),
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(part), F.lit("")).alias("part"),
        own_mask(value).alias("mask"),
    )
    return rows.groupBy(*ROW).agg(F.count("*").alias("n"))


class Audit:
    """The state and the counters of one stream, in one folder. ``step`` is called with each micro-batch."""

    def __init__(self, labels: DataFrame, folder: str, text: str = "text", part: str = "lang", doc_id: str = "doc_id"):
        self.spark = labels.sparkSession
        self.folder = folder
        self.names = {"text": text, "part": part, "doc_id": doc_id}
        by_id = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id"))
        flags = [F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int")).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))]
        self.labels = materialise(by_id.agg(*flags), "audit-labels")

    def path(self, name: str, batch: int) -> str:
        return f"{self.folder}/{name}/{batch}"

    def write(self, frame: DataFrame, name: str, batch: int) -> DataFrame:
        frame.write.mode("overwrite").parquet(self.path(name, batch))
        return self.spark.read.schema(frame.schema).parquet(self.path(name, batch))

    def step(self, docs: DataFrame, batch: int) -> None:
        """Count one micro-batch: its rows, its holders, and the earlier holders that a smaller id replaces."""
        seen = self.write(narrow(docs, **self.names), "seen", batch)
        flags = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
        rows = self.write(seen.join(self.labels, "doc_id", "left").select(*ROW, *flags, "n"), "rows", batch)

        with_id = rows.where(F.col("doc_id").isNotNull())
        least = with_id.groupBy("key").agg(F.min("doc_id").alias("doc_id"))
        candidates = with_id.join(least, ["key", "doc_id"]).select(*LABELLED, F.lit(True).alias("new"))
        if batch:
            earlier = self.spark.read.schema(rows.schema).parquet(*[self.path("holders", b) for b in range(batch)])
            earlier = earlier.join(least.select("key"), "key", "left_semi")
            candidates = candidates.unionByName(earlier.select(*LABELLED, F.lit(False).alias("new")))
        # Few rows share a text here: those of the smallest id in each batch so far.
        smallest = candidates.groupBy("key").agg(
            F.min("doc_id").alias("now"), F.min(F.when(~F.col("new"), F.col("doc_id"))).alias("before")
        )
        judged = candidates.join(smallest, "key")
        judged = self.write(judged, "judged", batch)
        holders = judged.where(F.col("new") & (F.col("doc_id") == F.col("now")))
        retracted = judged.where(~F.col("new") & (F.col("doc_id") == F.col("before")) & (F.col("before") > F.col("now")))
        self.write(holders.select(LABELLED), "holders", batch)

        repeated = F.when(F.col("doc_id").isNull(), F.col("mask")).otherwise(F.col("mask").bitwiseOR(F.lit(REPEATED)))
        as_repeated = [F.col(c) if c != "mask" else repeated.alias("mask") for c in COUNTER]
        changes = rows.select(*as_repeated, F.col("n").alias("n"))
        for frame, sign in ((holders, 1), (retracted, -1)):
            changes = changes.unionByName(frame.select(*COUNTER, (sign * F.col("n")).alias("n")))
            changes = changes.unionByName(frame.select(*as_repeated, (-sign * F.col("n")).alias("n")))
        self.write(changes.groupBy(*COUNTER).agg(F.sum("n").alias("n")), "changes", batch)

    def run(self, stream: DataFrame) -> DataFrame:
        """Process what the source holds now; the counters (part, mask, good, toxic, n) after the last micro-batch."""
        steps = []

        def step(docs: DataFrame, batch: int) -> None:
            self.step(docs, batch)
            steps.append(batch)

        sink = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{self.folder}/checkpoint")
        run = sink.trigger(availableNow=True).start()
        run.awaitTermination()
        return self.counters(max(steps, default=-1) + 1)

    def counters(self, batches: int) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], "part string, mask int, good int, toxic int, n long")
        changes = self.spark.read.parquet(*[self.path("changes", b) for b in range(batches)])
        return changes.groupBy(*COUNTER).agg(F.sum("n").alias("n"))


def interactions(counters: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: what the filter of that step does there."""
    count = F.col("n")
    masks = counters.groupBy("part", "mask").agg(
        F.sum(count).alias("n"),
        F.sum(F.when(F.col("good") == 1, count).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic") == 1, count).otherwise(0)).alias("toxic"),
    )
    bit = {name: 1 << k for k, name in enumerate(FILTERS)}
    steps = []
    for order in itertools.permutations(FILTERS):
        for step, name in enumerate(order):
            before = sum(bit[x] for x in order[:step])
            steps.append((("".join(order)), step + 1, bit[name], before))
    listed = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(own).alias("own"), F.lit(b).alias("before")) for o, s, own, b in steps])
    spread = masks.select("*", F.inline(listed))
    fails = F.col("mask").bitwiseAND(F.col("own")) != 0
    gone = F.col("mask").bitwiseAND(F.col("before")) != 0
    removed = fails & ~gone
    orders = len(steps) // len(FILTERS)

    def total(condition: Column, of: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(of)).otherwise(0)).cast("long")

    # A row that fails k filters is removed by each of them in one k-th of all orders.
    share = F.when(fails, F.col("n") * F.floor(F.lit(orders) / F.bit_count("mask"))).otherwise(0)
    return spread.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"),
        total(removed).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"),
        F.sum(share).cast("long").alias("shapley"),
    )


def as_stream(spark: SparkSession, path: str, batches: int = BATCHES) -> DataFrame:
    """The Parquet files under a path as a stream, read in about ``batches`` micro-batches of equal bytes.

    The last part of the path becomes a pattern that matches only itself: the file source takes a lone file only so.
    """
    read = spark.read.parquet(path)
    size = int(str(read._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    folder, _, name = path.rstrip("/").rpartition("/")
    stem, dot, kind = name.rpartition(".")
    stream = spark.readStream.schema(read.schema).option("maxBytesPerTrigger", str(max(1, -(-size // batches))))
    return stream.parquet(f"{folder}/{{{stem}}}{dot}{kind}" if stem else f"{folder}/{{{name}}}")


def audit(stream: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """The interaction report of a stream of documents. ``names``: the columns of text, part and doc_id."""
    folder = f"{shared_folder(labels.sparkSession)}/streams/audit-{uuid.uuid4().hex}"
    return interactions(Audit(labels, folder, **names).run(stream))


SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                      min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
words AS (SELECT *, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS w FROM texts),
flags AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
          FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
  FROM words LEFT JOIN flags USING (doc_id)),
counted AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, CAST(s AS INTEGER) AS step, filter_order[s] AS own, filter_order[1:s - 1] AS earlier
          FROM orders, unnest(range(1, 6)) AS r(s)),
judged AS (
  SELECT part, filter_order, step, own, fails, n, good, toxic, contains(fails, own) AS fail,
         earlier <> '' AND regexp_matches(fails, '[' || earlier || '.]') AS gone
  FROM counted, steps),
told AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (NOT fail AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fail AND NOT gone), 0) AS removed,
         coalesce(sum(n) FILTER (fail AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails,
         coalesce(sum(good) FILTER (fail AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (fail AND NOT gone), 0) AS toxic_lost
  FROM judged GROUP BY ALL),
shares AS (SELECT part, own, sum(removed) AS shapley FROM told GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(shapley AS BIGINT) AS shapley
FROM told JOIN shares USING (part, own)
"""


@query("op13_incremental_retraction", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(as_stream(spark, f"{sf_dir}/documents.parquet"), table(spark, sf_dir, "labels"))
