"""Encoding and decoding with a BPE piece model by suffix-array matching.

Texts are cut where no piece reaches across: before the space that begins a word, and around line ends.
The distinct words of a batch form one text, which a suffix array indexes to the depth of a piece;
binary search gives every piece's range of occurrences, so all occurrences of all pieces become edges
(start, end, piece) of a lattice over that text. Edges are sorted by where they end and relaxed in that order,
one step for the k-th byte of all words together.

What is relaxed is not a sum of scores, as the model is a BPE model: its result is the one that merging
pairs by rank leaves. A piece may end at a place if it follows the piece that ends where it starts; a piece
v follows u if merging "uv" would never join across the border. That is decided by going back in
time through the merges that made u and v: at each state of both sides next to the border, a merge across
it must not come before the next merge of either side. Exactly one piece can end at each place, so
relaxing leaves the result of merging. Characters without a piece become their bytes.

Words with several spaces in a row (whose pieces share one rank), and words in which relaxing leaves a place
open, are merged pair by pair. The model's path is a parameter; vocabulary tables are broadcast, the vocabulary bounds their size.

Null or empty texts have no ids and decode to the empty text. U+2581 is read as a space. Repeated rows are encoded each
for itself. Empty tables give empty results. Other columns pass through; result names are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillrank.llm.frames import add_columns, table
from quillrank.llm.registry import query
from quillrank.llm.tokens import list_array, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
GROUP_CHARS = 2_000_000
GROUP_IDS = 500_000
SLICE_BYTES = 400_000
NEVER = np.int32(1 << 30)
END = 0xFF  # stands after each word; no UTF-8 text has it
UNKNOWN = 1 << 19  # the piece of a character that has none
MEMORY = 1 << 20  # remembered answers to "may v follow u"


class Vocabulary:
    """Pieces, ranks, and for each piece the two that its last merge joins."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.unknown = model.unk_id()
        self.bytes_of = np.full(256, -1, np.int32)
        self.ids: dict[str, int] = {}
        self.texts = [b""] * n
        scores = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes_of[value] = i
                self.texts[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text = piece.replace(SPACE, " ")
                self.ids[text] = i
                self.texts[i] = text.encode()
                scores[text] = model.get_score(i)
        self.rank_of = {t: -scores[t] for t in self.ids}
        order = sorted(set(self.rank_of.values()))
        place = {r: k for k, r in enumerate(order)}
        self.rank_of = {t: place[r] for t, r in self.rank_of.items()}
        self.newline = any("\n" in t for t in self.ids)
        self.rank = np.full(n, -1, np.int32)
        self.left, self.right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        usable, joins = [], []
        for text, i in self.ids.items():
            if len(text) == 1:
                usable.append(i)
                continue
            halves = self.merge(text, stop=2)
            if " " in text[1:] or len(halves) != 2 or halves[0] not in self.ids or halves[1] not in self.ids:
                continue
            if self.merge(text) != [text]:
                continue
            usable.append(i)
            self.rank[i] = self.rank_of[text]
            self.left[i], self.right[i] = self.ids[halves[0]], self.ids[halves[1]]
            joins.append((int(self.left[i]) << 20 | int(self.right[i]), self.rank[i]))
        joins.sort()
        self.joins = np.array([j for j, _ in joins], np.int64)
        self.join_ranks = np.array([r for _, r in joins], np.int32)
        self.usable = np.array(sorted(usable, key=lambda i: self.texts[i]), np.int32)
        self.lengths = np.array([len(t) for t in self.texts], np.int32)
        self.flat = np.frombuffer(b"".join(self.texts), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths
        padded = [self.texts[i][:16].ljust(16, b"\0") for i in self.usable]
        self.head = np.array([int.from_bytes(p[:8], "big") for p in padded], np.uint64)
        self.rest = np.array([int.from_bytes(p[8:], "big") for p in padded], np.uint64)
        self.single = np.array(sorted(i for t, i in self.ids.items() if len(t) == 1), np.int32)
        self.remembered = None

    def merge(self, text: str, stop: int = 1) -> list[str]:
        """Merging by rank, leftmost first, until ``stop`` parts are left or no pair is a piece.

        The pairs wait in a heap, parts are linked by place: a long text takes little more time a character than a short one.
        """
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        waiting: list[tuple[int, int, int]] = []

        def offer(k: int) -> None:
            following = after[k]
            if following < len(parts):
                rank = self.rank_of.get(parts[k] + parts[following])
                if rank is not None:
                    heapq.heappush(waiting, (rank, k, len(parts[k]) + len(parts[following])))

        for k in range(len(parts) - 1):
            offer(k)
        left = len(parts)
        while waiting and left > stop:
            _, k, size = heapq.heappop(waiting)
            following = after[k]
            if parts[k] is None or following >= len(parts) or len(parts[k]) + len(parts[following]) != size:
                continue  # one side has been merged meanwhile
            parts[k], parts[following] = parts[k] + parts[following], None
            after[k] = after[following]
            if after[k] < len(parts):
                before[after[k]] = k
            left -= 1
            offer(k)
            if before[k] >= 0:
                offer(before[k])
        return [part for part in parts if part is not None]

    def merged_ids(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.merge(text):
            i = self.ids.get(part)
            out += [i] if i is not None else self.fallback(part)
        return out

    def fallback(self, part: str) -> list[int]:
        raw = part.encode()
        if (self.bytes_of[list(raw)] < 0).any():
            return [self.unknown]
        return self.bytes_of[list(raw)].tolist()

    def joined_rank(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        keys = u.astype(np.int64) << 20 | v
        at = np.minimum(np.searchsorted(self.joins, keys), len(self.joins) - 1)
        return np.where(self.joins[at] == keys, self.join_ranks[at], NEVER)

    def decide(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Whether v may follow u: no merge across the border comes before the next merge of either side."""
        fine = np.ones(len(u), bool)
        at = np.arange(len(u))
        x, y = u.copy(), v.copy()
        next_x, next_y = np.full(len(u), NEVER), np.full(len(u), NEVER)
        while len(at):
            across = self.joined_rank(x, y)
            # Of equal ranks the left one merges first: inside u before across, across before inside v.
            bad = (across < next_x) & (across <= next_y) & (across < NEVER)
            fine[at[bad]] = False
            rank_x, rank_y = self.rank[x], self.rank[y]
            go = ~bad & ((rank_x >= 0) | (rank_y >= 0))
            at, x, y, next_x, next_y, rank_x, rank_y = (z[go] for z in (at, x, y, next_x, next_y, rank_x, rank_y))
            back_x = rank_x > rank_y
            next_x = np.where(back_x, rank_x, next_x)
            next_y = np.where(back_x, next_y, rank_y)
            x, y = np.where(back_x, self.right[x], x), np.where(back_x, y, self.left[y])
        return fine

    def may_follow(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """``decide`` with a memory. u < 0: a word begins."""
        fine = (u < 0) | (u == UNKNOWN) | (v == UNKNOWN)
        ask = np.flatnonzero(~fine)
        if len(ask) == 0:
            return fine
        if self.remembered is None:
            self.remembered = np.full(MEMORY, -1, np.int64)
        u, v = u[ask], v[ask]
        keys = u.astype(np.int64) << 20 | v
        slot = (mix(keys.view(np.uint64)) & np.uint64(MEMORY - 1)).astype(np.int64)
        known = self.remembered[slot]
        answer = (known & 1) == 1
        new = np.flatnonzero(known >> 1 != keys)
        if len(new):
            pairs, back = np.unique(keys[new], return_inverse=True)
            decided = self.decide((pairs >> 20).astype(np.int32), (pairs & ((1 << 20) - 1)).astype(np.int32))
            answer[new] = decided[back]
            self.remembered[slot[new]] = keys[new] << 1 | answer[new]
        fine[ask] = answer
        return fine

    def __getstate__(self):
        return {**self.__dict__, "remembered": None}


def occurrences(data: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(start, piece) of every occurrence of every usable piece, by a suffix array of the text."""
    padded = np.concatenate([data, np.full(16, END, np.uint8)])
    n = len(data)
    head, rest = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for k in range(8):
        head = head << np.uint64(8) | padded[k : k + n]
        rest = rest << np.uint64(8) | padded[k + 8 : k + 8 + n]
    suffixes = np.lexsort((rest, head)).astype(np.int32)
    head = head[suffixes]
    lengths = vocabulary.lengths[vocabulary.usable]
    # Every suffix that begins with a piece lies between the piece and the piece filled up with ones.
    free = (np.uint64(8) * np.maximum(8 - lengths, 0).astype(np.uint64)) % np.uint64(64)
    top = vocabulary.head | ((np.uint64(1) << free) - np.uint64(1))
    low = np.searchsorted(head, vocabulary.head, "left")
    high = np.searchsorted(head, top, "right")
    sizes = high - low
    piece = np.repeat(np.arange(len(lengths), dtype=np.int32), sizes)
    at = np.arange(len(piece)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
    start = suffixes[at]
    # Pieces of more than eight bytes: also the rest must agree.
    long = np.flatnonzero(lengths[piece] > 8)
    if len(long):
        size = lengths[piece[long]]
        mask = ~np.uint64(0) << (np.uint64(8) * np.maximum(16 - size, 0).astype(np.uint64))
        same = (rest[start[long]] ^ vocabulary.rest[piece[long]]) & mask == 0
        for k in np.flatnonzero(same & (size > 16)):
            text = vocabulary.texts[vocabulary.usable[piece[long[k]]]]
            begin = int(start[long[k]])
            same[k] = data[begin : begin + len(text)].tobytes() == text
        keep = np.ones(len(piece), bool)
        keep[long] = same
        start, piece = start[keep], piece[keep]
    return start, vocabulary.usable[piece]


def encode_words(words: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after another, how many each has)."""
    raw = [w.encode() for w in words]
    data = np.frombuffer(bytes([END]).join(raw) + bytes([END]), np.uint8)
    sizes = np.array([len(r) for r in raw], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    owner = np.repeat(np.arange(len(words)), sizes + 1)
    start, piece = occurrences(data, vocabulary)
    # A character that is no piece gets an edge of its own.
    is_char = ((data & 0xC0) != 0x80) & (data != END)
    covered = np.zeros(len(data), bool)
    one_char = np.zeros(len(vocabulary.texts), bool)
    one_char[vocabulary.single] = True
    covered[start[one_char[piece]]] = True
    alone = np.flatnonzero(is_char & ~covered).astype(np.int32)
    length = vocabulary.lengths[piece]
    if len(alone):
        following = np.flatnonzero(is_char | (data == END))
        wide = following[np.searchsorted(following, alone, "right")] - alone
        start, piece = np.concatenate([start, alone]), np.concatenate([piece, np.full(len(alone), UNKNOWN, np.int32)])
        length = np.concatenate([length, wide.astype(np.int32)])
    end = start + length
    step = end - begins[owner[start]]
    by = np.argsort(step, kind="stable") if step.max(initial=0) > 65_535 else np.argsort(step.astype(np.uint16), kind="stable")
    start, end, piece = start[by], end[by], piece[by]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(step))])
    last = np.full(len(data) + 1, -2, np.int32)  # the piece that ends before a place; -1: a word begins, -2: not reached
    last[begins] = -1
    came = np.zeros(len(data) + 1, np.int32)
    for a, b in zip(bounds[1:-1].tolist(), bounds[2:].tolist(), strict=True):
        if a == b:
            continue
        s, e, v = start[a:b], end[a:b], piece[a:b]
        u = last[s]
        keep = np.flatnonzero((u != -2))
        keep = keep[vocabulary.may_follow(u[keep], v[keep])]
        # A place is reached by one piece; the start of a word is never an end.
        last[e[keep]] = v[keep]
        came[e[keep]] = s[keep]
    # Walk back from the end of every word, all words at once.
    used = np.zeros(len(data) + 1, bool)
    at, live = begins + sizes, np.arange(len(words))
    failed = []
    while len(live):
        open_ = (at > begins[live]) & (last[at] == -2)
        if open_.any():
            failed += live[open_].tolist()
        go = (at > begins[live]) & ~open_
        at, live = at[go], live[go]
        used[at] = True
        at = came[at].astype(np.int64)
    place = np.flatnonzero(used)
    ids, of = last[place], owner[place]
    if (ids == UNKNOWN).any():
        wide = np.where(ids == UNKNOWN, place - came[place], 1)
        which = np.repeat(np.arange(len(ids)), wide)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(wide) - wide, wide)
        values = vocabulary.bytes_of[data[came[place][which] + offset]]
        ids, of = np.where(ids[which] == UNKNOWN, values, ids[which]), of[which]
    counts = np.bincount(of, minlength=len(words))
    wrong = set(failed) | set(np.unique(of[ids < 0]).tolist()) | {k for k, w in enumerate(words) if "  " in w}
    if wrong:
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for k in wrong:
            parts[k] = np.array(vocabulary.merged_ids(words[k]), np.int32)
        ids, counts = np.concatenate(parts), np.array([len(p) for p in parts])
    return ids.astype(np.int32), counts


def encode_texts(texts: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    cut = re.compile(" *[^ ]+| +" if vocabulary.newline else "\n| *[^ \n]+| +")
    number: dict[str, int] = {}
    which, sizes = [], []
    for text in texts:
        found = cut.findall(" " + text.replace(SPACE, " ")) if text else []
        which.extend([number.setdefault(w, len(number)) for w in found])
        sizes.append(len(found))
    words = list(number)
    del number
    ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    first, total = 0, 0
    for k, word in enumerate(words):
        total += len(word) + 1
        if total >= SLICE_BYTES or k == len(words) - 1:
            some, many = encode_words(words[first : k + 1], vocabulary)
            ids.append(some)
            counts.append(many)
            first, total = k + 1, 0
    ids, counts = np.concatenate(ids), np.concatenate(counts)
    starts = np.cumsum(counts) - counts
    which = np.array(which, np.int64)
    lengths = counts[which] if len(which) else np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    flat = ids[np.arange(lengths.sum()) + np.repeat(starts[which] - ends + lengths, lengths)] if len(which) else ids
    upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
    return flat, np.diff(upto)


def decode_ids(ids: np.ndarray, counts: np.ndarray, vocabulary: Vocabulary) -> list[str]:
    lengths = vocabulary.lengths[ids]
    ends = np.cumsum(lengths)
    flat = vocabulary.flat[np.arange(lengths.sum()) + np.repeat(vocabulary.starts[ids] - ends + lengths, lengths)].tobytes()
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        text = flat[a:b].decode("utf-8", "replace")
        out.append(text[1:] if text.startswith(" ") else text)
    return out


@lru_cache(maxsize=4)
def vocabulary_of(path: str) -> Vocabulary:
    return Vocabulary(path)


ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])
DECODED = T.StructType([T.StructField("decoded", T.StringType()), T.StructField("ids_sha256", T.StringType())])


def parts_of(sizes: np.ndarray, most: int):
    """Ranges of consecutive rows of about ``most`` together, or one row that is larger."""
    first, total = 0, 0
    for k, size in enumerate(sizes.tolist()):
        total += size
        if total >= most or k == len(sizes) - 1:
            yield first, k + 1
            first, total = k + 1, 0


def decoded_arrays(ids: np.ndarray, counts: np.ndarray, vocabulary: Vocabulary) -> list[pa.Array]:
    bounds = np.concatenate([[0], np.cumsum(counts)])
    digests = [hashlib.sha256(ids[a:b].tobytes()).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return [pa.array(decode_ids(ids, counts, vocabulary), pa.string()), pa.array(digests, pa.string())]


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, decoded: bool = False) -> DataFrame:
    """The documents with ``ids`` and ``n_tokens``; if ``decoded``, with what ``decode`` adds, in the same pass.

    Rows leave in parts of about GROUP_CHARS characters, so that a worker's memory does not grow with the batch.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_of(model))

    def kernel(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text)).fill_null("")
            for a, b in parts_of(pc.utf8_length(column).to_numpy(), GROUP_CHARS):
                ids, counts = encode_texts(column.slice(a, b - a).to_pylist(), shared.value)
                arrays = [list_array(ids, counts, pa.int32()), pa.array(counts, pa.int64())]
                yield batch.slice(a, b - a), arrays + (decoded_arrays(ids, counts, shared.value) if decoded else [])

    return add_columns(docs, kernel, T.StructType(ENCODED.fields + DECODED.fields) if decoded else ENCODED)


def decode(encoded: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """The rows with ``decoded``, the text of their ids, and ``ids_sha256`` of the ids as little-endian 32-bit numbers."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary_of(model))

    def kernel(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).fill_null([])
            for a, b in parts_of(np.diff(lists.offsets.to_numpy()), GROUP_IDS):
                part = lists.slice(a, b - a)
                flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
                yield batch.slice(a, b - a), decoded_arrays(flat, np.diff(part.offsets.to_numpy()), shared.value)

    return add_columns(encoded, kernel, DECODED)


@query("op9_suffix_array_pieces")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    whole = encode(docs, decoded=True)
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), SPACE, " ")
    return whole.select("doc_id", "n_tokens", "ids", "ids_sha256", same.alias("round_trip"))
