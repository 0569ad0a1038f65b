"""N-gram Jaccard join by parity sketches: which texts share most of their word n-grams, and the groups they form.

A text is the set of 64-bit hashes of its distinct n-grams. Two sets of sizes n <= m with intersection / union
>= s differ in at most n (1 - s) / s elements. So:

1. Texts with equal sets are one class; only its smallest id goes on. A group of copies of any size costs
   one aggregation.
2. Sizes fall in bands; a set belongs to its own band and, if a partner may be smaller than that, to the
   one below. A band fixes D, the most by which linked sets may differ, and K > D segments of the hash range.
   Each segment of a set is XORed into one parity word. Linked sets agree on at least K - D segments
   (pigeonhole), so they meet in an equi-join on (band, segment, parity word, count). K has some segments to spare:
   a set leaves out its lightest segments, those of at most p elements, as long as no more than the spare
   ones are that light; of what two sets agree on, both then keep at least one.
3. Groups of a batch of rows are found where the batch is: its members are paired with the smallest of the batch,
   and only that one goes on, in packed blocks by hash of the key, to be paired with the smallest of all. So
   a group of any size sends one entry per batch. Never is all paired with all. Pairs are verified by their
   exact sets; linked members fall into components.
4. In groups whose members are then still in different components, members are paired with a few further ones,
   the same for all of the group, and verified; this is linear as well. Only what is apart after that is joined within
   its groups, across components only. Each set has a 512-bit parity sketch, one bit flipped per element, so that the Hamming distance
   of two sketches is at most the number of elements in which the sets differ: pairs further apart than a
   link allows are dropped inside the join. The rest is verified and joins the components.

No link between different components is left out, so the components are exact for 64-bit n-grams. Hot groups
are pre-aggregated (1, 3) and their joins are those that Spark splits when skewed.

A text with fewer words than ``words`` is one n-gram, its whole sequence; without words its set is empty and linked
with nothing. Letters A-Z count as a-z. A null id has a null component and takes no part. Rows that repeat an
id are one node: they share a component. Empty tables give empty results. Other columns pass through; columns
that bear a result's name are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.llm.components import components
from quillrank.llm.frames import add_columns, lean, release, small_enough, table, without
from quillrank.llm.recompression import sequence_hashes
from quillrank.llm.registry import query
from quillrank.llm.tokens import Words, list_array, mix, slices, text_bytes, windows
from quillrank.sources.shared import materialise

GROWTH = 1.6
SKETCH_WORDS = 8
BUCKET_KEYS = 500_000
KEY_BYTES = 8_000_000  # of texts whose keys are held at once


class Bands:
    """Sizes [low, next low) of each band, its D, K and spare segments, for links of percent / 100 or more."""

    def __init__(self, percent: int, largest: int = 1 << 40):
        lows = [1]
        while lows[-1] < largest:
            lows.append(max(lows[-1] + 1, int(lows[-1] * GROWTH)))
        self.percent = percent
        self.lows = np.array(lows)
        self.differ = (self.lows[1:] - 1) * (100 - percent) // percent
        self.spare = self.differ // 4
        self.segments = self.differ + 1 + self.spare

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, sizes, "right") - 1

    def also_below(self, sizes: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Whether a linked smaller set may lie in the band below."""
        least = -(-sizes * self.percent // 100)
        return (band > 0) & (least < self.lows[band])


def gram_sets(found: Words, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): each text's distinct n-grams in ascending order."""
    hashes = found.hashes(lower=True)
    grams, at = windows(hashes, found.bounds, words)
    owner = np.searchsorted(found.bounds, at, "right") - 1
    short = np.flatnonzero((found.counts > 0) & (found.counts < words))
    if len(short):
        whole = sequence_hashes(hashes, found.bounds, 5)
        grams, owner = np.concatenate([grams, whole[short]]), np.concatenate([owner, short])
    by = np.lexsort((grams, owner))
    grams, owner = grams[by], owner[by]
    new = np.ones(len(by), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], np.bincount(owner[new], minlength=len(found.counts))


def segment_keys(grams: np.ndarray, sizes: np.ndarray, bands: Bands, chosen: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, owner) of the segments that the chosen sets put forward in the given bands."""
    inside = np.repeat(chosen, sizes)
    part = grams[inside]
    owner = np.repeat(np.arange(len(sizes)), sizes)[inside]
    if len(part) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    segment = ((part >> np.uint64(32)) * bands.segments[band[owner]].astype(np.uint64)) >> np.uint64(32)
    head = np.ones(len(part), bool)
    head[1:] = (segment[1:] != segment[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(head)
    parity = np.bitwise_xor.reduceat(part, starts)
    count = np.diff(np.append(starts, len(part)))
    of, segment = owner[starts], segment[starts]
    # p: the most elements such that segments of at most p are no more than the spare ones. Empty ones count.
    spare = bands.spare[band]
    light = bands.segments[band] - np.bincount(of, minlength=len(sizes))  # empty segments
    p = np.where(light <= spare, 0, -1)
    for most in range(1, 64):
        light = light + np.bincount(of[count == most], minlength=len(sizes))
        better = (light <= spare) & (p == most - 1)
        if not better.any():
            break
        p[better] = most
    keep = count > p[of]
    key = mix(parity[keep] + mix(segment[keep] * np.uint64(0x9E3779B97F4A7C15) + mix(count[keep].astype(np.uint64) * np.uint64(1 << 20) + band[of[keep]].astype(np.uint64))))
    # A set with more empty segments than it may leave out puts them forward as well, as one key for each.
    bare = np.flatnonzero(chosen & (p < 0))
    if len(bare):
        keys, owners = [key], [of[keep]]
        for k in bare:
            full = np.unique(segment[of == k])
            empty = np.setdiff1d(np.arange(bands.segments[band[k]], dtype=np.uint64), full)
            keys.append(mix(mix(empty * np.uint64(0x9E3779B97F4A7C15) + mix(np.array([band[k]], np.uint64)))))
            owners.append(np.full(len(empty), k))
        return np.concatenate(keys), np.concatenate(owners)
    return key, of[keep]


def sketches(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(texts x SKETCH_WORDS) parity bits, one flipped per n-gram."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bit = (mix(grams) >> np.uint64(7)) % np.uint64(64 * SKETCH_WORDS)
    odd = np.bincount(owner * (64 * SKETCH_WORDS) + bit.astype(np.int64), minlength=len(sizes) * 64 * SKETCH_WORDS) & 1
    bits = odd.astype(np.uint8).reshape(len(sizes), SKETCH_WORDS * 64)
    return np.packbits(bits, axis=1).view(np.uint64).reshape(len(sizes), SKETCH_WORDS)


SUMMARY = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("f1", T.LongType()),
        T.StructField("f2", T.LongType()),
        *[T.StructField(f"s{k}", T.LongType()) for k in range(SKETCH_WORDS)],
    ]
)


def summaries(text: str, words: int):
    """Kernel: size, fingerprint and parity sketch of each text's set."""

    def kernel(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
            parts = []
            for a, b in slices(offsets):
                grams, sizes = gram_sets(Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), words)
                prints = []
                for seed in (3, 4):
                    sums = np.zeros(b - a, np.uint64)
                    has = sizes > 0
                    if has.any():
                        starts = (np.cumsum(sizes) - sizes)[has]
                        sums[has] = np.add.reduceat(mix(grams + np.uint64(seed)), starts)
                    prints.append(mix(sums + sizes.astype(np.uint64)).view(np.int64))
                parts.append((sizes, *prints, sketches(grams, sizes).view(np.int64)))
            if not parts:
                continue
            sizes, one, two, bits = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield batch, [pa.array(sizes), pa.array(one), pa.array(two), *[pa.array(np.ascontiguousarray(bits[:, k])) for k in range(SKETCH_WORDS)]]

    return kernel


def keys_of(texts: pa.Array, ids: np.ndarray, words: int, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(keys, ids) that the texts put forward, by key and id."""
    data, offsets = text_bytes(texts)
    keys, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in slices(offsets):
        grams, sizes = gram_sets(Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), words)
        band = bands.of(np.maximum(sizes, 1))
        below = bands.also_below(sizes, band) & (sizes > 0)
        for chosen, level in ((sizes > 0, band), (below, np.maximum(band - 1, 0))):
            found, owner = segment_keys(grams, sizes, bands, chosen, level)
            keys.append(found)
            of.append(ids[owner + a])
    keys, of = np.concatenate(keys), np.concatenate(of)
    by = np.lexsort((of, keys))
    return keys[by], of[by]


MEETS = "key long, id long, leader long"
BLOCK = "bucket long, base long, keys binary, far binary, leaders binary"


def group_starts(keys: np.ndarray) -> np.ndarray:
    head = np.ones(len(keys), bool)
    head[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(head)


def meeting_rows(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, ids, leaders) of the groups of two members or more; both sorted by key and id."""
    starts = group_starts(keys)
    sizes = np.diff(np.append(starts, len(keys)))
    several = np.repeat(sizes > 1, sizes)
    return keys[several], ids[several], np.repeat(ids[starts], sizes)[several]


def key_blocks(words: int, percent: int, buckets: int):
    """Kernel over (id, text): BLOCKs of the keys of a few megabytes of texts.

    The smallest id of each key goes to the key's bucket. Groups among these texts are complete as they are; they
    are dealt to any buckets, so that a key that many texts have burdens none.
    """

    def kernel(batches):
        bands = Bands(percent)
        parts = (batch.slice(a, b - a) for batch in batches for a, b in slices(text_bytes(batch.column(1))[1], KEY_BYTES))
        for batch in parts:
            keys, ids = keys_of(batch.column(1), batch.column(0).to_numpy(), words, bands)
            rows = []
            starts = group_starts(keys)
            first, least = keys[starts], ids[starts]
            bucket = (first % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            first, least, bucket = first[by], least[by], bucket[by]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a < b:
                    base = int(least[a:b].min())
                    far = least[a:b] - base
                    far = far.astype(np.uint32) if far.max() < 1 << 32 else far
                    rows.append((int(bucket[a]), base, first[a:b].tobytes(), far.tobytes(), None))
            own = meeting_rows(keys, ids)
            for k in range(0, len(own[0]), 20_000):
                part = [c[k : k + 20_000] for c in own]
                rows.append((int(mix(part[0][:1] + np.uint64(k))[0] % np.uint64(buckets)), 0, *(c.tobytes() for c in part)))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(5)], names=["bucket", "base", "keys", "far", "leaders"])

    return kernel


def meet_in_bucket(blocks: pa.Table) -> pa.Table:
    keys, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    ready = []
    for base, packed, far, leaders in zip(*(blocks.column(c).to_pylist() for c in ("base", "keys", "far", "leaders")), strict=True):
        own = np.frombuffer(packed, np.uint64)
        if leaders is not None:
            ready.append((own, np.frombuffer(far, np.int64), np.frombuffer(leaders, np.int64)))
            continue
        wide = np.uint32 if 2 * len(far) == len(packed) else np.int64
        keys.append(own)
        ids.append(np.frombuffer(far, wide).astype(np.int64) + base)
    keys, ids = np.concatenate(keys), np.concatenate(ids)
    by = np.lexsort((ids, keys))
    ready.append(meeting_rows(keys[by], ids[by]))
    columns = [np.concatenate(c) for c in zip(*ready, strict=True)]
    met = pa.table([pa.array(columns[0].view(np.int64)), pa.array(columns[1]), pa.array(columns[2])], names=["key", "id", "leader"])
    del keys, ids, ready, columns, blocks
    release()
    return met


def meetings(firsts: DataFrame, words: int, percent: int, grams: int) -> DataFrame:
    """MEETS: the members of every group of a key, each with a smaller member (its leader) or itself.

    ``firsts`` has (id, text), ``grams`` is how many n-grams there are about; it sets the number of buckets.
    """
    spark = firsts.sparkSession
    expected = 2 * grams * (100 - percent) // percent
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-expected // BUCKET_KEYS))
    return firsts.mapInArrow(lean(key_blocks(words, percent, buckets)), BLOCK).groupBy("bucket").applyInArrow(meet_in_bucket, MEETS)


def wide_sketches(text: str, words: int):
    """Kernel: parity sketches of 8 bits or more an n-gram. A power of two, so that a larger one folds to a smaller."""

    def kernel(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
            for a, b in slices(offsets):
                grams, sizes = gram_sets(Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), words)
                out = []
                for part in np.split(mix(grams), np.cumsum(sizes)[:-1]):
                    bits = 1 << max(6, int(8 * len(part)).bit_length())
                    odd = np.bincount((part & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
                    out.append(np.packbits(odd.astype(np.uint8)).tobytes())
                yield batch.slice(a, b - a), [pa.array(out, pa.binary()), pa.array(sizes)]

    return kernel


def near_sketches(batches):
    """The pairs whose wide sketches allow a link: differing bits are at most the elements in which the sets differ."""
    for batch in batches:
        a, b, n, m, percent, x, y = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "n", "m", "percent", "x", "y"))
        keep = []
        for k in range(batch.num_rows):
            left, right = (np.frombuffer(c[k].as_py(), np.uint8) for c in (x, y))
            while len(left) > len(right):
                left = left[: len(left) // 2] ^ left[len(left) // 2 :]
            while len(right) > len(left):
                right = right[: len(right) // 2] ^ right[len(right) // 2 :]
            distance = int(np.unpackbits(left ^ right).sum())
            p = percent[k].as_py()
            keep.append((100 + p) * distance <= (100 - p) * (n[k].as_py() + m[k].as_py()))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])


def gram_lists(text: str, words: int):
    def kernel(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
            for a, b in slices(offsets):
                grams, sizes = gram_sets(Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), words)
                yield batch.slice(a, b - a), [list_array(grams.view(np.int64), sizes, pa.int64())]

    return kernel


def linked(batches):
    """The pairs whose sets are similar enough: ``x`` and ``y`` are ascending hashes."""
    for batch in batches:
        names = batch.schema.names
        columns = [batch.column(names.index(c)) for c in ("a", "b", "percent")]
        xs, ys = batch.column(names.index("x")), batch.column(names.index("y"))
        keep = []
        for k in range(batch.num_rows):
            x, y = xs[k].values.to_numpy(), ys[k].values.to_numpy()
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= columns[2][k].as_py() * (len(x) + len(y) - both))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([c.filter(mask) for c in columns[:2]], names=["a", "b"])


def verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are links; ``texts`` has (id, text).

    Wide sketches, an eighth of the size of the sets, are compared first; only what they let pass meets its sets.
    """

    def both(pairs: DataFrame, name: str, kernel, made: list[T.StructField]) -> DataFrame:
        needed = materialise(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "needed")
        table = add_columns(texts.join(small_enough(needed), "id"), kernel, T.StructType(made))
        rest = [field.name for field in made[1:]]
        table = materialise(table.select("id", "made", *rest), name)
        left = table.select(F.col("id").alias("a"), F.col("made").alias("x"), *rest)
        right = table.select(F.col("id").alias("b"), F.col("made").alias("y"), *[F.col(c).alias("m") for c in rest])
        return pairs.join(left, "a").join(right, "b").withColumn("percent", F.lit(percent))

    sketch = [T.StructField("made", T.BinaryType()), T.StructField("n", T.LongType())]
    wide = both(pairs, "wide", wide_sketches("text", words), sketch)
    likely = materialise(wide.select("a", "b", "n", "m", "percent", "x", "y").mapInArrow(lean(near_sketches), "a long, b long"), "likely")
    sets = both(likely, "sets", gram_lists("text", words), [T.StructField("made", T.ArrayType(T.LongType()))])
    return materialise(sets.select("a", "b", "x", "y", "percent").mapInArrow(lean(linked), "a long, b long"), "verified")


def near(left: str, right: str, percent: int) -> Column:
    """Whether sizes and sketches of two sets still allow a link."""

    def side(alias: str, name: str) -> Column:
        return F.col(f"{alias}.{name}")

    distance = sum((F.bit_count(side(left, f"s{k}").bitwiseXOR(side(right, f"s{k}"))) for k in range(SKETCH_WORDS)), F.lit(0))
    n, m = side(left, "n"), side(right, "n")
    sizes = (100 * n >= percent * m) & (100 * m >= percent * n)
    return sizes & ((100 + percent) * distance <= (100 - percent) * (n + m))


def near_pairs(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link."""
    both = pairs.join(bits.alias("x"), F.col("a") == F.col("x.id")).join(bits.alias("y"), F.col("b") == F.col("y.id"))
    return both.where(near("x", "y", percent)).select("a", "b")


def apart(rows: DataFrame, labels: DataFrame, order: Column) -> tuple[DataFrame, DataFrame]:
    """The rows (key, id) of groups with several components, with ``label``; and of each such group the first by ``order``."""
    labelled = rows.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    labelled = materialise(labelled.select("key", "id", "label"), "labelled")
    groups = labelled.groupBy("key").agg(
        F.min("label").alias("p"), F.max("label").alias("q"), F.min(F.struct(order.alias("o"), "id", "label")).alias("f")
    )
    groups = materialise(groups.where("p < q").select("key", F.col("f.id").alias("leader"), F.col("f.label").alias("leader_label")), "groups")
    return labelled.join(groups.select("key"), "key"), groups


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """The documents with ``n_shingles`` and ``component_id``, the smallest id reachable by links."""
    docs = without(docs, ["_id", "_its", "_print"]).withColumn("_print", F.xxhash64(text))
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col("_print").alias("print"), F.col(text).alias("text"))
    known = materialise(add_columns(texts, summaries("text", words), SUMMARY).drop("text"), "sketches")
    classes = known.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("id").alias("least"))
    member = materialise(known.select("id", "print", "f1", "f2", "n").join(classes, ["f1", "f2", "n"], "left").select("id", "print", "n", "least"), "members")
    # Texts that go on: those with words whose set no smaller id has.
    copies = member.where("id is null or least is null or id > least").select("id", "print").distinct()
    copies = small_enough(materialise(copies.toDF("_id", "_its"), "copies"))

    def without_copies(frame: DataFrame) -> DataFrame:
        return frame.join(copies, F.col("id").eqNullSafe(F.col("_id")) & (F.col("print") == F.col("_its")), "left_anti")

    firsts = without_copies(known)
    grams = known.agg(F.sum("n")).first()[0] or 0
    meets = materialise(meetings(without_copies(texts).select("id", "text"), words, percent, grams), "meets")

    bits = materialise(firsts.select("id", "n", *[f"s{k}" for k in range(SKETCH_WORDS)]), "bits")
    star = meets.where("leader < id").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    star = materialise(near_pairs(star, bits, percent), "star")
    texts = texts.where(F.col("id").isNotNull()).select("id", "text")
    links = verify(star, texts, words, percent)
    labels = components(links)

    # Whoever is still apart meets other members of its groups: the smallest, the greatest, one by hash.
    # Each round is linear in the members of groups that more than one component shares.
    tested, open_rows = star, meets.select("key", "id").distinct()
    for order in (F.col("id"), -F.col("id"), F.xxhash64("key", "id")):
        open_rows, leaders = apart(open_rows, labels, order)
        pairs = open_rows.join(leaders, "key").where("label <> leader_label")
        pairs = pairs.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
        pairs = materialise(near_pairs(pairs, bits, percent).join(tested, ["a", "b"], "left_anti"), "pairs")
        more = verify(pairs, texts, words, percent)
        tested, links = tested.unionByName(pairs), links.unionByName(more)
        if more.limit(1).count():
            labels = components(links)
        open_rows = open_rows.select("key", "id")

    # What is left is joined within its groups, across components.
    open_rows, _ = apart(open_rows, labels, F.col("id"))
    open_rows = materialise(open_rows.join(bits, "id"), "open")
    across = open_rows.alias("x").join(
        open_rows.alias("y"),
        (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.label") != F.col("y.label")) & near("x", "y", percent),
    )
    across = across.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
    more = verify(materialise(across, "across"), texts, words, percent)
    if more.limit(1).count():
        labels = components(links.unionByName(more))

    final = member.join(labels, F.col("least") == F.col("node"), "left")
    final = final.select(F.col("id").alias("_id"), F.col("print").alias("_its"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("label", "least", "id")).alias("component_id"))
    final = materialise(final.distinct(), "components")
    results = ["n_shingles", "component_id"]
    same = F.col(key).eqNullSafe(F.col("_id")) & (F.col("_print") == F.col("_its"))
    return without(docs, results).join(small_enough(final), same, "left").drop("_id", "_its", "_print")


SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
          FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM texts WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared s JOIN sizes p ON p.doc_id = s.x JOIN sizes q ON q.doc_id = s.y WHERE 100 * s.n >= 85 * (p.n + q.n - s.n)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT b.y, reach.r FROM reach JOIN both_ways b ON b.x = reach.doc_id)
SELECT t.doc_id, CAST(coalesce(any_value(s.n), 0) AS BIGINT) AS n_shingles, min(r.r) AS component_id
FROM texts t LEFT JOIN sizes s USING (doc_id) JOIN reach r USING (doc_id) GROUP BY t.doc_id
"""


@query("op5_parity_sketch_join", SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")
