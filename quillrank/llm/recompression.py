"""Substring deduplication by recompression: rounds that give equal runs of words equal names.

Level 0 names every word. Level 1 names each maximal run of one word. Every further level splits the names
in two classes by a bit of the name itself and replaces each adjacent pair (first class, second class) by
the name of that pair. A name is a 64-bit hash of what it stands for, so all tasks name alike without asking each
other, and equal stretches of text get equal names wherever they are not touched by what stands around them.

Which names of a level a window of words fixes by itself, its interior, follows from the window alone:
a first name of the second class may pair with something outside and is left out, as is a last name of
the first class, and runs at either end. The window's anchor is the interior name with the smallest hash on the highest
level that has any (level 0 always has). So two equal windows have equal anchors, whatever surrounds them,
and a text's windows share few anchors: one for every 18 words in prose.

``dedup_substrings`` removes each word covered by a window of ``width`` words whose word sequence also
starts in a document with a smaller id:

1. Each text gives a hash of its whole word sequence and its distinct anchors. Of texts with equal
   sequences only the one with the smallest id goes on; every window of the others starts there.
2. Anchors found in two documents or more reveal where repeats can be; anchors are counted before the
   shuffle. All other windows are unique.
3. The windows with such anchors, named by 128 bits, verify: the smallest id of each is found, and windows
   of larger ids are marked. Again what is frequent is added up before the shuffle, and the join back
   is one that Spark splits where it is skewed.
4. Marked words are cut from the texts.

No step gathers the documents of an anchor or a window: a group of any size costs its rows once. Small tables
of decisions join the texts by broadcast if their written size allows it (``broadcast_bytes``), else by a
shuffle. Null or empty texts have no words. A null id gives and loses nothing. Rows that repeat an
id are judged each by its own text and never against each other. Empty tables give empty results. Other
columns pass through; columns that bear a result's name are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.llm.frames import add_columns, lean, small_enough, table, without
from quillrank.llm.registry import query
from quillrank.llm.tokens import Words, list_array, mix, slices, text_bytes, windows
from quillrank.sources.shared import materialise

WIDTH = 50
LEVELS = 9
LOOK = 6  # interior names among which the smallest is taken, from the left

RUN = np.uint64(0xD6E8FEB86659FD93)
LEFT, RIGHT = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def anchors(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, index of the first word) of each window of ``width`` words that lies in one text."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    remaining = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    at = np.flatnonzero(remaining >= width)
    if len(at) == 0:
        return np.zeros(0, np.uint64), at
    first, last = at.astype(np.int32), (at + width - 1).astype(np.int32)
    names = words
    breaks = np.zeros(n + 1, bool)  # a text begins at this name
    breaks[bounds] = True
    anchor = smallest(names, first, last)
    for level in range(1, LEVELS):
        if level == 1:
            head = np.ones(len(names), bool)
            head[1:] = (names[1:] != names[:-1]) | breaks[1:-1]
            starts = np.flatnonzero(head)
            index = np.cumsum(head, dtype=np.int32) - 1
            lengths = np.diff(np.append(starts, len(names))).astype(np.uint64)
            renamed = names[starts]
            long = lengths > 1
            renamed = np.where(long, mix(renamed * RUN + lengths), renamed)
            # The run at either end may go on outside.
            first, last = index[first] + 1, index[last] - 1
        else:
            side = (mix(names + np.uint64(level)) >> np.uint64(17)) & np.uint64(1)
            second = side == 1
            tail = np.zeros(len(names), bool)  # the second of a pair
            tail[1:] = second[1:] & ~second[:-1] & ~breaks[1:-1]
            starts = np.flatnonzero(~tail)
            index = np.cumsum(~tail, dtype=np.int32) - 1
            renamed = names[starts]
            paired = np.flatnonzero(tail)
            renamed[index[paired]] = mix(names[paired - 1] * LEFT + mix(names[paired] * RIGHT))
            inside = first <= last
            f, b = np.minimum(first, len(names) - 1), np.maximum(np.minimum(last, len(names) - 1), 0)
            f = np.minimum(f + second[f], len(names))
            b = b - ~second[b]
            grown = np.append(index, len(starts)).astype(np.int32)
            first = np.where(inside, grown[f], 1)
            last = np.where(inside, index[np.maximum(b, 0)], 0)
            last = np.where(inside & (f > b), first - 1, last)
        breaks = np.append(breaks[starts], True)
        names = renamed
        # Names of a window that has none left on this level keep what they had.
        live = first <= last
        if not live.any():
            break
        anchor[live] = smallest(names, first[live], last[live])
        first, last = np.where(live, first, 1), np.where(live, last, 0)
    return anchor, at


def smallest(names: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The name with the smallest hash among the first ``LOOK`` of each range."""
    rank = mix(names + RUN)
    best = first.copy()
    for k in range(1, LOOK):
        at = np.minimum(first + k, last)
        best = np.where(rank[at] < rank[best], at, best)
    return names[best]


def sequence_hashes(words: np.ndarray, bounds: np.ndarray, seed: int) -> np.ndarray:
    """One hash of the whole word sequence of each text; 0 if it has no words."""
    counts = np.diff(bounds)
    out = np.zeros(len(counts), np.uint64)
    has = counts > 0
    if has.any():
        place = (np.arange(len(words)) - np.repeat(bounds[:-1], counts)).astype(np.uint64)
        terms = words * (mix(place + np.uint64(seed)) | np.uint64(1))
        out[has] = mix(np.add.reduceat(terms, bounds[:-1][has]) + counts[has].astype(np.uint64))
    return out


def summaries(text: str, width: int):
    """Kernel: words, hashes of the whole sequence, distinct anchors of each text."""

    def kernel(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
            counts, one, two, keys, sizes = [], [], [], [], []
            for a, b in slices(offsets):
                found = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                hashes = found.hashes()
                counts.append(found.counts)
                one.append(sequence_hashes(hashes, found.bounds, 11))
                two.append(sequence_hashes(hashes, found.bounds, 1 << 40))
                anchor, at = anchors(hashes, found.bounds, width)
                owner = np.searchsorted(found.bounds, at, "right") - 1
                by = np.lexsort((anchor, owner))
                anchor, owner = anchor[by], owner[by]
                new = np.ones(len(by), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
                keys.append(anchor[new])
                sizes.append(np.bincount(owner[new], minlength=b - a))
            if not counts:
                continue
            keys = np.concatenate(keys).view(np.int64)
            yield (
                batch,
                [
                    pa.array(np.concatenate(counts)),
                    pa.array(np.concatenate(one).view(np.int64)),
                    pa.array(np.concatenate(two).view(np.int64)),
                    list_array(keys, np.concatenate(sizes), pa.int64()),
                ],
            )

    return kernel


def revealed_windows(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """The windows of ``docs`` whose anchor is among the document's ``_shared``: two hashes, id, text hash, place."""

    def kernel(batches):
        for batch in batches:
            names = batch.schema.names
            ids = np.asarray(batch.column(names.index("_id")).to_numpy(zero_copy_only=False))
            prints = np.asarray(batch.column(names.index("_print")).to_numpy(zero_copy_only=False))
            lists = batch.column(names.index("_shared"))
            shared = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            sizes = np.diff(lists.offsets.to_numpy())
            owners = np.repeat(np.arange(len(sizes)), sizes).astype(np.uint64)
            wanted = np.unique(mix(shared + mix(owners)))
            data, offsets = text_bytes(batch.column(names.index("_text")))
            for a, b in slices(offsets):
                found = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                hashes = found.hashes()
                anchor, at = anchors(hashes, found.bounds, width)
                owner = np.searchsorted(found.bounds, at, "right") - 1
                hit = np.isin(mix(anchor + mix((owner + a).astype(np.uint64))), wanted)
                if not hit.any():
                    continue
                one, _ = windows(hashes, found.bounds, width, 1)
                two, _ = windows(found.hashes(2), found.bounds, width, 2)
                at, owner = at[hit], owner[hit]
                columns = [
                    pa.array(one[hit].view(np.int64)),
                    pa.array(two[hit].view(np.int64)),
                    pa.array(ids[owner + a]),
                    pa.array(prints[owner + a]),
                    pa.array((at - found.bounds[owner]).astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["w1", "w2", "id", "print", "at"])

    rows = docs.select(F.col(key).alias("_id"), F.col("_print"), F.col(text).alias("_text"), "_shared")
    return rows.mapInArrow(lean(kernel), "w1 long, w2 long, id long, print long, at int")


def cut_words(text: str, width: int):
    """Kernel: what is left of each text, of which ``_starts`` are the marked windows, or all if ``_copy``."""

    def kernel(batches):
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index(text)).to_pylist()
            copies = batch.column(names.index("_copy")).to_pylist()
            marked = batch.column(names.index("_starts"))
            n_words, n_removed, kept, digests = [], [], [], []
            for k, value in enumerate(texts):
                raw = (value or "").encode()
                words = raw.split()  # bytes are split at 09-0D and 20 only
                starts = marked[k].as_py() or ()
                left, out = words, value or ""
                if copies[k]:
                    left, out = [], ""
                elif starts:
                    gone = np.zeros(len(words) + 1, np.int32)
                    np.add.at(gone, np.asarray(starts), 1)
                    np.add.at(gone, np.asarray(starts) + width, -1)
                    keep = np.cumsum(gone[:-1]) == 0
                    left = [w for w, k_ in zip(words, keep.tolist(), strict=True) if k_]
                    out = without_words(raw, keep)
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(out)
                digests.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield batch, [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(digests, pa.string())]

    return kernel


def without_words(raw: bytes, keep: np.ndarray) -> str:
    """The text without the words that go, each with the white space that follows it."""
    found = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    ends = np.append(found.starts[1:], len(raw))
    parts, runs = [], np.flatnonzero(np.diff(np.concatenate([[0], keep.view(np.int8), [0]])))
    for a, b in zip(runs[::2], runs[1::2], strict=True):
        parts.append(raw[found.starts[a] : ends[b - 1]])
    return b"".join(parts).decode()


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """The documents with n_words, n_removed, kept_text and kept_sha256."""
    docs = without(docs, ["_print", "_shared", "_copy", "_starts"]).withColumn("_print", F.xxhash64(text))
    added = T.StructType(
        [
            T.StructField("n", T.LongType()),
            T.StructField("s1", T.LongType()),
            T.StructField("s2", T.LongType()),
            T.StructField("anchors", T.ArrayType(T.LongType())),
        ]
    )
    texts = docs.where(F.col(key).isNotNull() & (F.length(text) >= 2 * width - 1))  # shorter texts have no window
    texts = texts.select(F.col(key).cast("long").alias("id"), "_print", F.col(text).alias("text"))
    known = add_columns(texts, summaries("text", width), added).drop("text").where(F.col("n") >= width)
    known = materialise(known.withColumnRenamed("_print", "print"), "anchors")
    classes = known.groupBy("s1", "s2").agg(F.min("id").alias("least"))
    ranked = known.join(classes, ["s1", "s2"])
    firsts = ranked.where(F.col("id") == F.col("least"))
    keys = firsts.select("id", F.explode("anchors").alias("anchor"))
    twice = keys.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("anchor")
    shared = materialise(keys.join(twice, "anchor").groupBy("id").agg(F.collect_set("anchor").alias("_shared")), "shared")

    revealed = docs.join(small_enough(shared), F.col(key) == F.col("id")).drop("id")
    found = materialise(revealed_windows(revealed, key, text, width), "windows")
    least = found.groupBy("w1", "w2").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("w1", "w2", "a")
    marked = found.join(least, ["w1", "w2"]).where("a < id")
    marked = marked.groupBy("id", "print").agg(F.collect_set("at").alias("_starts"))
    copies = ranked.where("id > least").select("id", "print", F.lit(True).alias("_copy"), F.lit(None).cast("array<int>").alias("_starts"))
    decided = copies.distinct().unionByName(marked.withColumn("_copy", F.lit(False)))
    decided = materialise(decided.withColumnRenamed("print", "_its"), "removed")

    joined = docs.join(small_enough(decided), (F.col(key) == F.col("id")) & (F.col("_print") == F.col("_its")), "left")
    results = T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept_text", T.StringType()),
            T.StructField("kept_sha256", T.StringType()),
        ]
    )
    return add_columns(joined.drop("id", "_its", "_print"), cut_words(text, width), results).drop("_copy", "_starts")


SQL = r"""
WITH texts AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
spots AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS win
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM texts WHERE len(w) >= 50)),
firsts AS (SELECT win, min(doc_id) AS least FROM spots GROUP BY win HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM spots JOIN firsts USING (win) WHERE least < doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM texts),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS text FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM texts t LEFT JOIN counts c USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""


@query("op2_substring_recompression", SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
