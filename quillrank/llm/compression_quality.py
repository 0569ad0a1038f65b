"""Quality classifier by compression: which of two dictionaries makes a text smaller.

One zstandard dictionary is trained on texts labelled good, one on texts labelled bad. Whole texts are cut
into chunks of ``CHUNK`` bytes, each compressed with either dictionary, so that a long text cannot learn from
itself what the dictionaries should tell. The difference of the two total sizes, over the text's own size,
is the evidence; how far the text shrinks at all (a text of endless repeats shrinks under any
dictionary) is the second. Logistic regression on labelled texts that the dictionaries have not seen turns both
into the probability of label 1.

The dictionaries and the calibration are fitted on a bounded sample of the labelled rows: per class the
``fit_docs`` rows with the smallest hash, each text cut to ``fit_bytes``; scoring reads whole texts.

Null and empty texts score the share of good texts in the sample, as does everything if a class has no
rows (with no rows at all: 0.5). Repeated rows are judged alike, each for itself. Empty tables give
empty results. Other columns pass through; columns that bear a result's name are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.llm.frames import add_columns, crc_mod, table
from quillrank.llm.registry import query

FIT_DOCS = 3_000
FIT_BYTES = 8_192
CHUNK = 4_096
DICTIONARY_BYTES = 65_536
LEVEL = 3
THRESHOLD = 0.3


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; of too few texts to train on, the texts themselves."""
    chunks = [t[i : i + CHUNK] for t in texts for i in range(0, len(t), CHUNK)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, chunks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(chunks)[-DICTIONARY_BYTES:]


class Sizes:
    """Compressed sizes under both dictionaries. Made where it is used: compressors do not travel."""

    def __init__(self, good: bytes, bad: bytes):
        self.compressors = []
        for data in (good, bad):
            words = zstandard.ZstdCompressionDict(data)
            words.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False, write_dict_id=False))

    def features(self, text: bytes) -> tuple[float, float]:
        chunks = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
        good, bad = (sum(len(c.compress(chunk)) for chunk in chunks) for c in self.compressors)
        return (bad - good) / len(text), min(good, bad) / len(text)


def design(features: np.ndarray) -> np.ndarray:
    """The difference, the ratio and its square, and how much they mean together."""
    x, r = features[:, 0] * 10, features[:, 1]
    return np.column_stack([np.ones(len(x)), x, r, r * r, x * r])


def logistic(features: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights by Newton's method with a small ridge."""
    x, y = design(features), labels.astype(float)
    w = np.zeros(x.shape[1])
    ridge = np.diag([0.0] + [1e-2] * (x.shape[1] - 1)) + 1e-9 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - ridge @ w
        step = np.linalg.solve(x.T @ (x * np.maximum(p * (1 - p), 1e-6)[:, None]) + ridge, gradient)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, fit_docs: int, fit_bytes: int
) -> tuple[bytes, bytes, np.ndarray, float]:
    """(good dictionary, bad dictionary, weights, share of good rows); dictionaries are empty if a class is missing."""
    rows = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("label"), F.xxhash64(key).alias("order"))
    rows = rows.where(F.col("label").isin(0, 1) & F.col("_key").isNotNull())
    counts = {row["label"]: row["n"] for row in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    picked = [rows.where(F.col("label") == value).orderBy("order", "_key").limit(fit_docs) for value in (1, 0)]
    # At most 2 * fit_docs ids, so they may be broadcast whatever the size of the tables.
    sample = docs.select(F.col(key), F.col(text).alias("text")).join(
        F.broadcast(picked[0].unionByName(picked[1]).distinct()), F.col(key) == F.col("_key")
    )
    found = sample.where(F.length("text") > 0).select("label", "order", F.substring("text", 1, fit_bytes).alias("text")).collect()
    found.sort(key=lambda row: (row["order"], row["text"]))
    samples = [[row["text"].encode()[:fit_bytes] for row in found if row["label"] == value] for value in (1, 0)]
    if min(map(len, samples)) < 4:
        return b"", b"", np.zeros(5), share
    good, bad = (dictionary(sample[::2]) for sample in samples)
    sizes = Sizes(good, bad)
    unseen = [sample[1::2] for sample in samples]
    features = np.array([sizes.features(t) for sample in unseen for t in sample])
    labels = np.repeat([1, 0], [len(sample) for sample in unseen])
    weights = logistic(features, labels)
    # The sample is balanced more than the rows are; the intercept takes the true odds.
    weights[0] += np.log(counts[1] / counts[0]) - np.log(len(unseen[0]) / len(unseen[1]))
    return good, bad, weights, share


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    fit_docs: int = FIT_DOCS,
    fit_bytes: int = FIT_BYTES,
) -> DataFrame:
    """The documents with ``size_difference``, ``size_ratio`` and the calibrated ``score``.

    ``labels`` has the rows to learn from: ``key`` and ``label``.
    """
    good, bad, weights, share = learn(docs, labels, key, text, label, fit_docs, fit_bytes)
    shared = docs.sparkSession.sparkContext.broadcast((good, bad, weights, share))

    def kernel(batches):
        good, bad, weights, share = shared.value
        sizes = Sizes(good, bad) if good else None
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            features = np.zeros((len(texts), 2))
            judged = np.zeros(len(texts), bool)
            if sizes:
                for k, t in enumerate(texts):
                    if t:
                        features[k], judged[k] = sizes.features(t.encode()), True
            odds = np.clip(design(features) @ weights, -30, 30)
            scores = np.where(judged, 1 / (1 + np.exp(-odds)), share)
            yield batch, [pa.array(features[:, 0]), pa.array(features[:, 1]), pa.array(scores)]

    added = T.StructType([T.StructField(n, T.DoubleType()) for n in ("size_difference", "size_ratio", "score")])
    return add_columns(docs, kernel, added)


@query("op6_compression_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(crc_mod("doc_id", 5) != 0)
    return score_quality(docs, labels).select(
        "doc_id",
        F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
