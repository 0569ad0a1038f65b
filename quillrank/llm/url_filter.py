"""URL filter: the ratio of two character language models, beside explicit rules.

Rules name a host and a path, as in ``example.org/en/``; a rule fits its host, the subdomains of it and
paths that start with its path, and the longest that fits decides. URLs that no rule fits are judged by
two variable-order Markov models of bytes, one of accepted and one of rejected URLs (those that the
rules decide). Each model blends orders 0 to ``order``: an order's counts are smoothed towards the
order below by its number of different continuations (Witten-Bell), down to a uniform byte. The
score is log2 P(accepted) - log2 P(rejected), divided by the number of symbols; the threshold is the
one that separates held-out rule-judged URLs best (mean of both error rates).

The models are fitted on a bounded sample of the labelled rows: per class the ``fit_rows`` URLs with the
smallest hash, of at most ``fit_chars`` characters. n-gram counts are added up in Spark; what the driver
gets is bounded by fit_rows * (fit_chars + 1) * (order + 1) counts a class and in practice far less.

A null URL, or one without ``://``, has an empty host and path and fits no rule; the model scores its text
(null: empty). If a class has no rows, nothing can be compared and the method allows. Repeated rows are
judged alike, each for itself. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.llm.frames import add_columns, table
from quillrank.llm.registry import query
from quillrank.llm.tokens import mix, randoms

ORDER = 5
FIT_ROWS = 20_000
FIT_CHARS = 2_000
# (verdict, host/path)
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, else null."""
    chosen = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        chosen = F.when(fits, F.lit(rule)).otherwise(chosen)
    return chosen


def symbols(urls: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For all symbols of all URLs: the URL's index, the byte (3 ends), and per order a hash of what precedes."""
    texts = [(u or "").encode() for u in urls.to_pylist()]
    data = np.frombuffer(b"".join(b"\x02" * order + t + b"\x03" for t in texts), np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(lengths + order)
    owner = np.repeat(np.arange(len(texts)), lengths)
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.arange(len(owner)) - first + np.repeat(ends - lengths, lengths)
    contexts, total = [], np.zeros(len(at), np.uint64)
    for k in range(order + 1):
        if k:
            total = total + randoms(100 + k, 256)[data[at - k]]
        contexts.append(mix(total + np.uint64(k + 1)))
    return owner, data[at], contexts


def gram(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return mix(context + (symbol.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


class Models:
    """Counts of both classes: of contexts (total, kinds of continuation) and of context with symbol."""

    def __init__(self, order: int, context: np.ndarray, symbol: np.ndarray, counts: np.ndarray):
        self.order = order
        keys = gram(context, symbol)
        by = np.argsort(keys)
        self.grams, self.gram_counts = keys[by], counts[by]
        self.contexts, group = np.unique(context, return_inverse=True)
        self.totals = np.zeros((len(self.contexts), 2))
        self.kinds = np.zeros((len(self.contexts), 2))
        np.add.at(self.totals, group, counts)
        np.add.at(self.kinds, group, counts > 0)

    @staticmethod
    def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys

    def scores(self, urls: pa.Array) -> np.ndarray:
        """log2 P(accepted) - log2 P(rejected), per symbol."""
        owner, symbol, contexts = symbols(urls, self.order)
        p = np.full((len(owner), 2), 1 / 257)
        for context in contexts:
            at, known = self.find(self.contexts, context)
            there, seen = self.find(self.grams, gram(context, symbol))
            totals, kinds = self.totals[at], self.kinds[at]
            counts = np.where(seen[:, None], self.gram_counts[there], 0)
            usable = known[:, None] & (totals > 0)
            p = np.where(usable, (counts + kinds * p) / np.maximum(totals + kinds, 1), p)
        ratio = np.log2(p[:, 0]) - np.log2(p[:, 1])
        n = np.bincount(owner, minlength=len(urls))
        return np.bincount(owner, ratio, minlength=len(urls)) / n


def scored(frame: DataFrame, url: str, models: Models, name: str) -> DataFrame:
    shared = frame.sparkSession.sparkContext.broadcast(models)

    def kernel(batches):
        for batch in batches:
            urls = batch.column(batch.schema.get_field_index(url))
            parts = [shared.value.scores(urls.slice(i, 2_000)) for i in range(0, len(urls), 2_000)]
            yield batch, [pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())]

    return add_columns(frame, kernel, T.StructType([T.StructField(name, T.DoubleType())]))


def fit(labelled: DataFrame, url: str, accepted: str, order: int, fit_rows: int, fit_chars: int) -> tuple[Models | None, float]:
    """The models and the threshold, from a bounded sample of rows with a boolean ``accepted``."""
    short = labelled.where(F.length(url) <= fit_chars).select(F.col(url).alias("url"), F.col(accepted).alias("accepted"))
    short = short.withColumn("order", F.xxhash64("url"))
    parts = [short.where(F.col("accepted") == side).orderBy("order", "url").limit(fit_rows) for side in (True, False)]
    sample = parts[0].unionByName(parts[1]).withColumn("held", F.pmod(F.col("order"), F.lit(5)) == 0)

    def count(batches):
        for batch in batches:
            urls, sides = batch.column(0), np.asarray(batch.column(1).to_pylist(), bool)
            owner, symbol, contexts = symbols(urls, order)
            pairs = np.rec.fromarrays([np.concatenate(contexts), np.tile(symbol, order + 1), np.tile(sides[owner], order + 1)], names="c,s,a")
            rows, n = np.unique(pairs, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows.c.view(np.int64)), pa.array(rows.s.astype(np.int32)), pa.array(np.where(rows.a, n, 0)), pa.array(np.where(rows.a, 0, n))],
                names=["context", "symbol", "yes", "no"],
            )

    counted = sample.where(~F.col("held")).select("url", "accepted").mapInArrow(count, "context long, symbol int, yes long, no long")
    rows = counted.groupBy("context", "symbol").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).toArrow().to_pandas()
    if len(rows) == 0 or rows.yes.sum() == 0 or rows.no.sum() == 0:
        return None, 0.0
    models = Models(order, rows.context.to_numpy().view(np.uint64), rows.symbol.to_numpy().astype(np.uint8), rows[["yes", "no"]].to_numpy(float))
    held = scored(sample.where("held").select("url", "accepted"), "url", models, "score").select("accepted", "score").toArrow().to_pandas()
    return models, best_threshold(held.score.to_numpy(float), held.accepted.to_numpy(bool))


def best_threshold(scores: np.ndarray, accepted: np.ndarray) -> float:
    """The threshold with the least mean of both error rates; 0 if a class is missing."""
    if len(scores) == 0 or accepted.all() or not accepted.any():
        return 0.0
    by = np.argsort(scores, kind="stable")
    scores, accepted = scores[by], accepted[by]
    missed = np.concatenate([[0], np.cumsum(accepted)]) / accepted.sum()  # accepted below the cut
    passed = 1 - np.concatenate([[0], np.cumsum(~accepted)]) / (~accepted).sum()
    edges = np.concatenate([[scores[0] - 1], scores, [scores[-1] + 1]])
    cuts = (edges[:-1] + edges[1:]) / 2
    return float(cuts[int(np.argmin(missed + passed))])


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]] = RULES,
    url: str = "url",
    order: int = ORDER,
    fit_rows: int = FIT_ROWS,
    fit_chars: int = FIT_CHARS,
) -> DataFrame:
    """The rows with host, path, rule, score (bits per symbol, positive: like accepted URLs) and verdict."""
    frame = pages.withColumn("host", url_host(F.col(url))).withColumn("path", url_path(F.col(url)))
    frame = frame.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules))
    decided = F.lit(None).cast("string")
    for verdict, rule in rules:
        decided = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(decided)
    labelled = frame.where(F.col("rule").isNotNull()).select(F.col(url), (decided == "allow").alias("accepted"))
    models, threshold = fit(labelled, url, "accepted", order, fit_rows, fit_chars)
    if models is None:
        frame = frame.withColumn("score", F.lit(0.0))
    else:
        frame = scored(frame, url, models, "score")
    by_model = F.when(F.col("score") >= threshold, F.lit("allow")).otherwise(F.lit("block"))
    return frame.withColumn("verdict", F.coalesce(decided, by_model))


@query("op3_url_model_ratio")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "score")
