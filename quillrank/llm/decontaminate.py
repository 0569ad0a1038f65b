"""Benchmark decontamination: one Aho-Corasick automaton over the test items, one scan of each text.

Texts are normalised byte by byte, so that an offset in the normalised text is an offset in the
original: A-Z become a-z, bytes that belong to no word become spaces. The automaton holds every window
of ``width`` item words (an item of fewer words is one window) between single spaces; one pass over a
text finds all occurrences of all windows, overlapping ones included.

The benchmark is a stated set. Its windows are counted before anything is shipped; a set of more than
``block`` windows is scanned in blocks, one automaton each, and the hits are united, so that no task
ever holds more than one block.

Null or empty texts have no words and no hits; null or empty items have no windows. Repeated rows are
treated alike, each for itself. Equal windows of several items count for all of them. Empty tables give
empty results. Other columns pass through; columns that bear a result's name are replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.llm.frames import add_columns, table, without
from quillrank.llm.registry import query

WIDTH = 10
BLOCK = 1_000_000
TABLE = bytes(
    byte + 32 if 65 <= byte <= 90 else byte if byte >= 128 or 48 <= byte <= 57 or 97 <= byte <= 122 else 32
    for byte in range(256)
)
ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def normal_words(text: str | None) -> list[bytes]:
    return text.encode().translate(TABLE).split() if text else []


def item_windows(words: list[bytes], width: int) -> list[bytes]:
    if not words:
        return []
    return [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


def benchmark_windows(benchmark: DataFrame, width: int, item: str, text: str) -> DataFrame:
    """(window, items): each distinct window with the sorted ids of the items that have it."""

    def cut(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            pairs = [(str(i), w) for i, t in zip(ids, texts, strict=True) if i is not None for w in set(item_windows(normal_words(t), width))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for _, w in pairs], pa.binary()), pa.array([i for i, _ in pairs], pa.string())],
                names=["window", "item"],
            )

    rows = benchmark.select(F.col(item).cast("string"), F.col(text)).mapInArrow(cut, "window binary, item string")
    return rows.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def scan_kernel(block: list[tuple[bytes, list[str]]], text: str):
    """Adds one block's hits to those that the batch may carry from earlier blocks."""

    def kernel(batches):
        automaton = ahocorasick.Automaton()
        for window, items in block:
            automaton.add_word(" " + window.decode("latin-1") + " ", (window.count(b" ") + 1, items))
        automaton.make_automaton()
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index(text)).to_pylist()
            old_hits = batch.column(names.index("_hits")).to_pylist() if "_hits" in names else [None] * len(texts)
            old_items = batch.column(names.index("items")).to_pylist() if "_hits" in names else [None] * len(texts)
            n_words, hits, spans, found = [], [], [], []
            for value, before, items_before in zip(texts, old_hits, old_items, strict=True):
                raw = value.encode() if value else b""
                plain = raw.translate(TABLE)
                words = plain.split()
                line = " " + b" ".join(words).decode("latin-1") + " "
                matches = list(automaton.iter(line)) if words and block else []
                items, hit = set(items_before or ()), set(before or ())
                if matches:
                    # The k-th space of the line stands before word k.
                    ends = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
                    last = np.searchsorted(ends, [m[0] for m in matches])
                    for end, (_, (size, ids)) in zip(last.tolist(), matches, strict=True):
                        hit.update(range(end - size, end))
                        items.update(ids)
                n_words.append(len(words))
                hits.append(sorted(hit))
                found.append(sorted(items))
                spans.append(character_spans(raw, plain, hits[-1]) if hit else [])
            yield batch, [
                pa.array(n_words, pa.int64()),
                pa.array([len(h) for h in hits], pa.int64()),
                pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                pa.array(found, pa.list_(pa.string())),
                pa.array(hits, pa.list_(pa.int64())),
            ]

    return kernel


def character_spans(raw: bytes, plain: bytes, hit: list[int]) -> list[list[int]]:
    """[start, end) in characters of the original text for each run of hit words."""
    places = [m.span() for m in re.finditer(rb"[^ ]+", plain)]
    character = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # characters up to each byte
    spans: list[list[int]] = []
    for k in hit:
        start, end = int(character[places[k][0]]) - 1, int(character[places[k][1] - 1])
        if spans and k - 1 == previous:
            spans[-1][1] = end
        else:
            spans.append([start, end])
        previous = k
    return spans


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WIDTH,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """The documents with n_words, n_hit, hit_spans (character offsets of the original) and items."""
    spark = docs.sparkSession
    found = benchmark_windows(benchmark, width, item, item_text)
    number = F.pmod(F.xxhash64("window"), F.lit(max(1, -(-found.count() // block))))
    blocks = defaultdict(list)
    for row in found.select("window", "items", number.alias("block")).toLocalIterator():
        blocks[row["block"]].append((bytes(row["window"]), list(row["items"])))
    state = T.StructType([*ADDED.fields, T.StructField("_hits", T.ArrayType(T.LongType()))])
    frame = without(docs, ["_hits", *ADDED.names])
    for windows in list(blocks.values()) or [[]]:
        shared = spark.sparkContext.broadcast(windows)
        frame = add_columns(frame, lambda batches, shared=shared: scan_kernel(shared.value, text)(batches), state)
    return frame.drop("_hits")


SQL = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wanted AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS win
           FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
spots AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
          FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
                FROM texts JOIN (SELECT DISTINCT size FROM wanted) s ON len(w) >= s.size)),
found AS (SELECT doc_id, i, s.size, item_id FROM spots s JOIN wanted USING (win)),
hits AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM texts t LEFT JOIN hits h USING (doc_id) LEFT JOIN named n USING (doc_id)
"""


@query("op7_benchmark_decontamination", SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    checked = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return checked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
