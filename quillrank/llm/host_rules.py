"""Host-level quality rules in DataFrame functions only.

1. ``measures``: counts of each text, by array functions inside one row; no shuffle. Repeated windows
   are found by sorting (hash of eight words, place) and comparing neighbours; texts whose window hashes
   are all distinct skip that.
2. ``host_rates``: documents that fail any rule (the base rules, symbols, repeated lines, length of words) added up per host
   before any shuffle. A host's rate is shrunk with a beta prior whose two parameters are the moments of the
   rates of all hosts, so that a host of few documents is judged mainly by what is usual and a large one by its own.
3. Verdicts joined back: a host fails if its shrunk rate lies ``TAIL`` standard deviations of the prior above the prior's
   mean, and is at least ``least``: where all hosts are alike, none is put aside for being the worst. A document
   is kept if it passes the base rules itself and its host does not fail.

Null and empty texts have no words and fail the base rules. A null host is a host of its own. Repeated
rows are judged each for itself. Empty tables give empty results. The measures are written once and read
twice; the host table, one row for each host, is joined as Spark decides, with skew split by AQE.
Windows are told apart by a 64-bit hash within one text. Columns of the input named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm.frames import table, without
from quillrank.llm.registry import query
from quillrank.sources.shared import materialise

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MAX_SYMBOL_PERCENT = 10  # of the characters of words
MAX_DUP_LINE_PERCENT = 30
WORD_LENGTHS = (2, 15)  # of a text's words, on average
LEAST = 0.4  # a host's shrunk rate of failures is at least this if it fails
TAIL = 4.0
RESULTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "any_failed", "host_docs", "shrunk_rate", "host_failed", "kept"]


def measures(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The columns of ``docs`` without the text, and the counts of each text."""
    value = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(value, F.lit(SPACES))
    others = [c for c in docs.columns if c != text]
    # Each step is a column of its own, so that Spark computes it once.
    step = docs.select(
        *others,
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+")).alias("_words"),
        F.length(F.translate(value, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(value) - F.length(F.translate(value, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(value, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "").alias("_lines"),
    )
    step = step.select(
        *others,
        F.size("_words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_words") < window, F.array().cast("array<bigint>"))
        .otherwise(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size("_words") - (window - 1), F.lit(1))),
                lambda i: F.xxhash64(F.slice("_words", i, window)),
            )
        )
        .alias("_hashes"),
    )
    counts = [*others, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    return step.select(
        *counts,
        F.when(F.size(F.array_distinct("_hashes")) == F.size("_hashes"), F.lit(0).cast("long"))
        .otherwise(covered(repeated_places(F.col("_hashes")), window))
        .alias("n_repeat_words"),
    )


def repeated_places(hashes: Column) -> Column:
    """The sorted places of the hashes that are found twice or more in an array."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def marked(sorted_pairs: Column) -> Column:
        last = F.size(sorted_pairs) - 1

        def place(p: Column, k: Column) -> Column:
            same = (k > 0) & (F.get(sorted_pairs, k - 1)["h"] == p["h"])
            same = same | ((k < last) & (F.get(sorted_pairs, k + 1)["h"] == p["h"]))
            return F.when(same, p["i"])

        return F.array_sort(F.array_compact(F.transform(sorted_pairs, place)))

    # As the variable of a lambda the sorted pairs are computed once, not once for each place.
    return F.get(F.transform(F.array(pairs), marked), F.lit(0))


def covered(places: Column, window: int) -> Column:
    """How many words lie in windows that begin at these sorted places."""
    return F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("at")),
        lambda state, p: F.struct(
            (state["n"] + F.least(F.lit(window), p - state["at"])).cast("long").alias("n"), p.alias("at")
        ),
        lambda state: state["n"],
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def any_failed() -> Column:
    """Whether a document fails any rule; these count for its host."""
    symbols = 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars")
    lines = 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines")
    lengths = ~F.col("word_chars").between(WORD_LENGTHS[0] * F.col("n_words"), WORD_LENGTHS[1] * F.col("n_words"))
    return base_failed() | symbols | lines | lengths


def host_rates(judged: DataFrame, host: str, failed: str, least: float) -> DataFrame:
    """Per host: documents, failures, the failure rate shrunk by an empirical beta prior, and whether that is far above it."""
    hosts = judged.groupBy(host).agg(F.count("*").alias("n"), F.count_if(failed).alias("failures"))
    moments = hosts.agg(
        F.struct(
            F.coalesce(F.sum("failures") / F.sum("n"), F.lit(0.0)).alias("mean"),
            F.coalesce(F.var_samp(F.col("failures") / F.col("n")), F.lit(0.0)).alias("variance"),
        ).alias("m")
    )
    mean, variance, weight = F.col("_m.mean"), F.col("_m.variance"), F.col("_weight")
    # Of a beta distribution: variance = mean (1 - mean) / (a + b + 1). Bounds keep it a prior when all
    # hosts are alike (no variance) or are as different as can be.
    fitted = F.least(F.greatest(mean * (1 - mean) / F.greatest(variance, F.lit(1e-9)) - 1, F.lit(1.0)), F.lit(1000.0))
    limit = F.greatest(F.lit(least), mean + TAIL * F.sqrt(mean * (1 - mean) / (weight + 1)))
    return (
        hosts.withColumn("_m", moments.scalar())
        .withColumn("_weight", fitted)
        .withColumn("shrunk_rate", (F.col("failures") + mean * weight) / (F.col("n") + weight))
        .withColumn("host_failed", F.col("shrunk_rate") >= limit)
        .drop("_m", "_weight")
    )


def judge_hosts(docs: DataFrame, host: str, text: str = "text", least: float = LEAST) -> DataFrame:
    """Each document with its measures, ``base_failed``, its host's rate and ``kept``."""
    docs = without(docs, [c for c in [*RESULTS, "_words", "_lines", "_hashes", "_host"] if c != host])
    judged = measures(docs, text).withColumn("base_failed", base_failed()).withColumn("any_failed", any_failed())
    judged = materialise(judged, "measures")
    verdicts = host_rates(judged, host, "any_failed", least).select(
        F.col(host).alias("_host"), F.col("n").alias("host_docs"), "shrunk_rate", "host_failed"
    )
    joined = judged.join(verdicts, F.col(host).eqNullSafe(F.col("_host")), "left").drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


SQL = r"""
WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT doc_id, source, t, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM texts),
spots AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) >= 8)),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM spots) WHERE n > 1),
cover AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM again) GROUP BY doc_id),
base AS (
  SELECT w.doc_id, w.source, CAST(len(w.w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[ \t-\r]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM words w LEFT JOIN cover c USING (doc_id)),
judged AS (
  SELECT *, base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines
            OR word_chars NOT BETWEEN 2 * n_words AND 15 * n_words AS any_failed
  FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (any_failed) AS f FROM judged GROUP BY source),
m AS (SELECT coalesce(sum(f) / sum(n), 0.0) AS mean, coalesce(var_samp(f / n), 0.0) AS v FROM hosts),
p AS (SELECT mean, least(greatest(mean * (1 - mean) / greatest(v, 1e-9) - 1, 1.0), 1000.0) AS k FROM m),
verdicts AS (SELECT source, (f + mean * k) / (n + k) >= greatest(0.4, mean + 4.0 * sqrt(mean * (1 - mean) / (k + 1))) AS host_failed FROM hosts, p)
SELECT j.doc_id, j.n_words, j.word_chars, j.n_symbols, j.n_dup_lines, j.n_repeat_words, j.base_failed,
       NOT j.base_failed AND NOT v.host_failed AS kept
FROM judged j JOIN verdicts v ON j.source IS NOT DISTINCT FROM v.source
"""


@query("op4_host_quality_rules", SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return judge_hosts(docs, "source").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
