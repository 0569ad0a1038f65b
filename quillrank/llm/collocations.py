"""Collocations by weighted acyclic automata.

1. ``pack``: each task turns the texts of a language, a few megabytes at a time, into a shard: its sorted words with their
   counts and its pieces as word numbers. Texts are split once; later passes read shards.
2. ``frequent``: word counts are added up by Spark. For pairs, and then for three to five words at once, each shard
   sorts its phrases and builds from them a count automaton for each prefix range. A range's automata meet in one group,
   are united, and give the phrases that are frequent in all shards. Only phrases whose words (then pairs) are frequent are counted: a phrase
   is no more frequent than its parts. A bitmap of at most 8 MB tells shards which are; what it lets through wrongly
   is counted and dropped, so the result is exact at every size.
3. ``parts``: frequent phrases, in order, become automata again; composed with the phrases themselves they give the counts of
   all beginnings, and over reversed phrases of all ends.
4. ``collocations``: scores of the cuts in exact decimals, phrases without a longer one of the same count, the first of each language.

A prefix range is a range of the hash of the first word, so that ranges are even; a word with more than a range's share of
all words is cut further by the words after it. Ranges grow in number with the words of a language, so a group holds
about ``RANGE_WORDS`` phrases at any input size. Words are told apart by their bytes, never by a hash.

Defined cases: a null text has no words, a null language is ``und``. Texts of any length are split whole. Repeated rows count
each time. Languages with no candidate give no row. An empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrank.llm.automata import Counts, mix, sort_rows, union
from quillrank.llm.frames import small_enough, table
from quillrank.llm.registry import query
from quillrank.sources.shared import materialise

LEAST = 100
LONGEST = 5
FIRST = 2000
SHARD_BYTES = 4_000_000  # text of one language in a shard; a longer text is a shard of its own
RANGE_WORDS = 2_000_000
BITS = 1 << 26
BREAKS = "[.,;:!?\\n\\x0b\\x0c\\r]+"
GROUP_ROWS = 200_000  # phrases with one beginning, above which the next word splits them too

SHARDS = "lang string, words array<string>, counts array<bigint>, stream binary"
PIECES = "lang string, range int, automaton binary"
PHRASES = "lang string, phrase string, a bigint"


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words in order, counts, word numbers of all texts with -1 between pieces)."""
    low = pc.replace_substring_regex(pc.ascii_lower(texts.cast(pa.large_string())), BREAKS, " \n ")
    low = pc.replace_substring(low, "\t", " ")
    end, blank = (pa.scalar(c, pa.large_string()) for c in "\n ")
    tokens = pc.split_pattern(pc.binary_join_element_wise(low, end, blank), " ").flatten()
    coded = tokens.filter(pc.not_equal(tokens, "")).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    words = coded.dictionary.take(pa.array(order))
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    stream = place[coded.indices.to_numpy()]
    at = pc.index(words, pa.scalar("\n", words.type)).as_py()
    if at < 0:
        return words, np.bincount(stream, minlength=len(words)), stream
    words = pa.concat_arrays([words.slice(0, at), words.slice(at + 1)])
    stream = np.where(stream == at, -1, stream - (stream > at)).astype(np.int32)
    return words, np.bincount(stream[stream >= 0], minlength=len(words)), stream


def shard_row(lang: str, chunks: list[pa.Array]) -> pa.RecordBatch:
    words, counts, stream = split(pa.concat_arrays(chunks))
    packed = zstandard.ZstdCompressor(level=1).compress(stream.tobytes())
    whole = [np.array([0, len(words)], np.int32)]
    columns = [
        pa.array([lang]),
        pa.ListArray.from_arrays(whole[0], words.cast(pa.string())),
        pa.ListArray.from_arrays(whole[0], pa.array(counts.astype(np.int64))),
        pa.array([packed], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "words", "counts", "stream"])


def pack(shard_bytes: int):
    """Kernel over (lang, text): a shard whenever a language has that many bytes."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return shard_rows(batches, shard_bytes)

    return kernel


def shard_rows(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[pa.Array]] = {}
    sizes: dict[str, int] = {}
    # Few rows at a time: what is held of a batch keeps only those alive.
    for batch in (batch.slice(k, 500) for batch in batches for k in range(0, batch.num_rows, 500)):
        langs, texts = batch.column(0), batch.column(1)
        for lang in pc.unique(langs).to_pylist():
            own = texts.filter(pc.equal(langs, lang))
            bytes_of = np.cumsum(pc.binary_length(own).to_numpy())
            start = 0
            while start < len(own):
                free = shard_bytes - sizes.get(lang, 0) + (int(bytes_of[start - 1]) if start else 0)
                end = max(start + 1, int(np.searchsorted(bytes_of, free, side="right")))
                held.setdefault(lang, []).append(own.slice(start, end - start))
                sizes[lang] = sizes.get(lang, 0) + int(bytes_of[min(end, len(own)) - 1] - (bytes_of[start - 1] if start else 0))
                start = end
                if sizes[lang] >= shard_bytes or start < len(own):
                    yield shard_row(lang, held.pop(lang))
                    sizes.pop(lang)
        while sum(sizes.values()) > 4 * shard_bytes:
            largest = max(sizes, key=lambda x: sizes[x])
            yield shard_row(largest, held.pop(largest))
            sizes.pop(largest)
    for lang, chunks in held.items():
        yield shard_row(lang, chunks)


def word_hashes(lang: str, words: list[str]) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w.encode(), seed) for w in words), np.uint64, len(words))


def row_hashes(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A hash of each row of word numbers; -1 is no word."""
    out = np.zeros(len(rows), np.uint64)
    for d in range(rows.shape[1]):
        out = np.where(rows[:, d] >= 0, mix(out + hashes[rows[:, d]]), out)
    return out


def has_bit(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes % np.uint64(64 * len(bitmap))
    return (bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def bitmap_of(phrases: DataFrame) -> np.ndarray:
    """A bit for the hash of each phrase. At most ``BITS`` bits, so that it can be sent to all tasks."""
    count = phrases.count()
    slots = max(1, min(BITS, 1 << (32 * count).bit_length()) >> 6)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            found = np.zeros(len(langs), np.uint64)
            for k, phrase in enumerate(batch.column(1).to_pylist()):
                own = word_hashes(langs[k], phrase.split(" "))
                found[k] = row_hashes(own, np.arange(len(own))[None, :])[0]
            slot = found % np.uint64(64 * slots)
            values = np.uint64(1) << (slot & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).astype(np.int64)), pa.array(values.view(np.int64))], names=["slot", "bits"])

    rows = phrases.select("lang", "phrase").mapInArrow(bits, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits"))
    found = rows.toArrow()
    bitmap = np.zeros(slots, np.uint64)
    bitmap[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bitmap


def phrases_of(stream: np.ndarray, hashes: np.ndarray, bitmap: np.ndarray, pairs: bool) -> np.ndarray:
    """Word numbers of the phrases of a shard that may be frequent: two words long, or three to five."""
    if len(stream) < 2:
        return np.zeros((0, LONGEST), np.int32)
    two = np.stack([stream[:-1], stream[1:]], axis=1)
    if pairs:
        good = np.append(has_bit(bitmap, row_hashes(hashes, np.arange(len(hashes))[:, None])), False)[stream]
        return padded(two[good[:-1] & good[1:]])
    good = (two >= 0).all(axis=1)
    good[good] = has_bit(bitmap, row_hashes(hashes, two[good]))
    found = []
    run = good
    for n in range(3, LONGEST + 1):
        run = run[:-1] & good[n - 2 :]  # all pairs of the n words that start here
        at = np.flatnonzero(run)
        found.append(padded(stream[at[:, None] + np.arange(n)]))
    return np.concatenate(found)


def padded(rows: np.ndarray) -> np.ndarray:
    out = np.full((len(rows), LONGEST), -1, np.int32)
    out[:, : rows.shape[1]] = rows
    return out


def shard_automata(bitmap, pairs: bool):
    """Kernel over (lang, words, stream, ranges, hot): a count automaton of the shard for each prefix range."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                lang, ranges = batch.column(0)[k].as_py(), batch.column(3)[k].as_py()
                words = batch.column(1)[k].values
                stream = np.frombuffer(zstandard.ZstdDecompressor().decompress(batch.column(2)[k].as_py()), np.int32)
                hashes = word_hashes(lang, words.to_pylist())
                found = phrases_of(stream, hashes, bitmap.value, pairs)
                if not len(found):
                    continue
                rows, counts = sort_rows(found, np.ones(len(found), np.int64))
                by = hashes[rows[:, 0]]
                hot = pc.is_in(words, pa.array(batch.column(4)[k].as_py() or [], words.type)).to_numpy(zero_copy_only=False)
                again = hot[rows[:, 0]]
                by[again] = row_hashes(hashes, rows[again])
                owner = ((mix(by) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(owner, kind="stable")  # rows stay in order within a range
                cuts = np.flatnonzero(np.concatenate([[True], np.diff(owner[order]) != 0, [True]]))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    own = rows[order[a:b]]
                    used, number = np.unique(np.append(own, -1), return_inverse=True)
                    number = number[:-1].reshape(own.shape) - 1
                    packed = Counts.of(number, counts[order[a:b]]).pack(words.take(pa.array(used[1:])))
                    columns = [pa.array([lang]), pa.array([int(owner[order[a]])], pa.int32()), pa.array([packed], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "range", "automaton"])

    return kernel


def unite(least: int):
    """One range of one language: its automata united, and the phrases that reach the least count."""

    def fold(key, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, waiting, size = None, [], 0

        def merged(parts):
            words, rows, counts = union(parts, LONGEST)
            return words, Counts.of(rows, counts)

        for batch in batches:
            for k in range(batch.num_rows):
                waiting.append(Counts.unpack(batch.column(2)[k].as_py()))
                size += len(waiting[-1][1].label)
                if size > RANGE_WORDS:
                    whole = merged(([whole] if whole else []) + waiting)
                    waiting, size = [], 0
        words, rows, counts = union(([whole] if whole else []) + waiting, LONGEST)
        rows, counts = rows[counts >= least], counts[counts >= least]
        used, rows = np.unique(np.append(rows, -1), return_inverse=True)
        rows = rows[:-1].reshape(-1, LONGEST) - 1
        names = words.take(pa.array(used[1:])).to_pylist()
        phrases = [" ".join(names[w] for w in row if w >= 0) for row in rows.tolist()]
        columns = [pa.array([key[0].as_py()] * len(phrases), pa.string()), pa.array(phrases, pa.string()), pa.array(counts)]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "a"])

    return fold


def frequent(shards: DataFrame, langs: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, a): all phrases of one to five words with at least that count."""
    spark = shards.sparkSession
    words = shards.select("lang", F.inline(F.arrays_zip("words", "counts"))).groupBy("lang", F.col("words").alias("phrase"))
    found = [materialise(words.agg(F.sum("counts").alias("a")).where(F.col("a") >= least), "words")]
    # Words above a range's share: fewer than there are ranges.
    hot = found[0].join(langs.where("ranges > 1"), "lang").where(F.col("a") > F.col("n") / F.col("ranges"))
    hot = hot.groupBy("lang").agg(F.collect_list("phrase").alias("hot"))
    known = small_enough(materialise(langs.join(hot, "lang", "left").select("lang", "ranges", "hot"), "ranges"))
    inputs = shards.select("lang", "words", "stream").join(known, "lang")
    inputs = inputs.select("lang", "words", "stream", "ranges", "hot")
    for pairs in (True, False):
        bitmap = spark.sparkContext.broadcast(bitmap_of(found[-1]))
        pieces = inputs.mapInArrow(shard_automata(bitmap, pairs), PIECES)
        grouped = pieces.groupBy("lang", "range").applyInArrow(_typed(unite(least)), PHRASES)
        found.append(materialise(grouped, "phrases"))
        bitmap.unpersist()
    return found[0].unionByName(found[1]).unionByName(found[2])


def _typed(fold):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fold(key, batches)

    return run


def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel over rows in the order of (lang, w): the counts of the beginnings of ``w``, as far as the partition holds them.

    A batch is one automaton; the beginnings of a batch's last row go on to the next batch.
    """
    carry: tuple[str | None, list[str], list[int]] = (None, [], [])
    for batch in batches:
        langs, w, counts = batch.column("lang"), batch.column("w"), batch.column("a").to_numpy()
        sizes = pc.list_value_length(w).to_numpy()
        coded = pa.concat_arrays([w.flatten(), pa.array(carry[1], w.type.value_type)]).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        numbers = place[coded.indices.to_numpy()]
        rows = np.full((batch.num_rows, LONGEST), -1, np.int64)
        owner = np.repeat(np.arange(batch.num_rows), sizes)
        rows[owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = numbers[: len(owner)]
        last = numbers[len(owner) :]
        found = np.zeros(rows.shape, np.int64)
        for lang in pc.unique(langs).to_pylist():
            own = pc.equal(langs, lang).to_numpy(zero_copy_only=False)
            known, of = rows[own], counts[own]
            if lang == carry[0]:
                before = [padded(last[None, : d + 1]) for d, c in enumerate(carry[2]) if c]
                known = np.concatenate([*before, known])
                of = np.concatenate([np.array([c for c in carry[2] if c], np.int64), of])
            known, first = np.unique(known, axis=0, return_index=True)
            found[own] = Counts.of(known, of[first]).walk(rows[own])
        carry = (langs[-1].as_py(), w[-1].as_py(), found[-1][: sizes[-1]].tolist())
        flat = found[owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in batch.schema.names] + [lists], names=[*batch.schema.names, "found"])


def parts(phrases: DataFrame, ends: bool, name: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Phrases with the counts of their beginnings of 1, 2, ... words; with ``ends``, of their ends of 1, 2, ... words.

    Phrases are dealt out by their first word. Where very many begin alike they are dealt out by two or three words, and
    the counts of the shorter beginnings, of which there are few, are joined on.
    """
    w = F.split("phrase", " ")
    frame = phrases.withColumn("w", F.reverse(w) if ends else w)
    key = F.slice("w", 1, 1)
    shorter = []
    for depth in (1, 2):
        head = F.slice("w", 1, depth)
        counted = frame.where(F.size("w") >= depth).groupBy("lang", head.alias("head")).agg(F.count("*").alias("rows"), F.max(F.when(F.size("w") == depth, F.col("a"))).alias(f"head{depth}"))
        # At most one in ``group_rows`` phrases heads so many.
        many = materialise(counted.where(F.col("rows") > group_rows).drop("rows"), "heads")
        shorter.append((F.broadcast(many), depth))
    for many, depth in shorter:
        frame = frame.withColumn("head", F.slice("w", 1, depth)).join(many, ["lang", "head"], "left").drop("head")
        key = F.when(F.col(f"head{depth}").isNotNull(), F.slice("w", 1, depth + 1)).otherwise(key)
    columns = [c for c in phrases.columns if c != "a"]
    rows = frame.select(*columns, "a", "w", F.coalesce("head1", F.lit(0)).alias("head1"), F.coalesce("head2", F.lit(0)).alias("head2"), F.array_join(key, " ").alias("key"))
    dealt = rows.repartition("lang", "key").sortWithinPartitions("lang", "w")
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    done = dealt.mapInArrow(compose, f"{schema}, found array<bigint>")
    known = F.transform("found", lambda c, i: F.when(c > 0, c).when(i == 0, F.col("head1")).when(i == 1, F.col("head2")))
    return done.select(*columns, "a", known.alias(name))


def cuts(length: Column) -> Column:
    """The lowest score of all cuts of a phrase, in exact decimals: (score, k, l, r)."""

    def cut(k: Column) -> Column:
        left, right = F.get("l", k - 1), F.get("r", length - k - 1)
        exact = [c.cast("decimal(20,0)") for c in (F.col("a"), F.col("n"), left, right)]
        score = F.call_function("div", exact[0] * exact[1] * F.lit(1000).cast("decimal(4,0)"), exact[2] * exact[3])
        return F.struct(score.cast("long").alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(1), length - 1), cut))


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    first: int = FIRST,
    shard_bytes: int = SHARD_BYTES,
    range_words: int = RANGE_WORDS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score. The last three change no result."""
    texts = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).alias("text")).where("text <> ''")
    shards = materialise(texts.mapInArrow(pack(shard_bytes), SHARDS), "shards")
    sizes = shards.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)).alias("n"))
    langs = materialise(sizes.withColumn("ranges", F.ceil(F.col("n") / range_words).cast("int")).where("n > 0"), "langs")
    phrases = materialise(frequent(shards, langs, least), "phrases")
    whole = parts(parts(phrases, False, "l", group_rows), True, "r", group_rows).withColumn("w", F.split("phrase", " "))
    whole = materialise(whole, "parts")

    # One word more with the same count: a longer phrase of the same count always has such a part.
    longer = whole.where(F.size("w") > 2)
    inner = F.array(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1))
    held = longer.select("lang", F.explode(inner).alias("w"), "a").groupBy("lang", "w").agg(F.max("a").alias("longest"))
    candidates = whole.where(F.size("w") > 1).join(held, ["lang", "w"], "left").where(F.col("longest").isNull() | (F.col("longest") < F.col("a")))
    scored = candidates.join(langs.select("lang", "n"), "lang").withColumn("cut", cuts(F.size("w")))
    scored = scored.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # The first of each of 64 heaps, then of those: a language's phrases never meet in one task.
    heap = Window.partitionBy("lang", "heap").orderBy(*order)
    top = scored.withColumn("heap", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(heap)).where(F.col("rank") <= first)
    top = top.drop("heap").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return top.where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS p
        FROM documents)),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces WHERE len(w) > 0),
grams AS (SELECT lang, w[i:i + k - 1] AS g FROM starts, unnest(range(1, 6)) AS r(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, g, count(*) AS a FROM grams GROUP BY lang, g HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
longer AS (
  SELECT lang, g, max(a) AS most FROM (
    SELECT lang, unnest([g[1:len(g) - 1], g[2:len(g)]]) AS g, a FROM f WHERE len(g) > 2) GROUP BY lang, g),
cuts AS (
  SELECT f.lang, f.g, f.a, k, t.n, p.a AS l, s.a AS r,
         (1000::HUGEINT * f.a * t.n::HUGEINT) // (p.a::HUGEINT * s.a) AS score
  FROM f JOIN totals t ON t.lang = f.lang, unnest(range(1, 5)) AS c(k)
  JOIN f p ON p.lang = f.lang AND p.g = f.g[1:k] JOIN f s ON s.lang = f.lang AND s.g = f.g[k + 1:len(f.g)]
  WHERE k < len(f.g)),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
ranked AS (
  SELECT b.*, array_to_string(b.g, ' ') AS phrase,
         row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(b.g, ' ')) AS rank
  FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.g = b.g WHERE o.most IS NULL OR o.most < b.a)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
       CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""


@query("op12_count_transducers", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
