"""Language identification by cross-parsing against a suffix automaton of each language.

A text is cut greedily into phrases, each the longest that occurs in a language's labelled text; the
language that needs the fewest phrases per symbol wins (ties: the first by name). Longest matches come
from the suffix automaton of that language's sample, whose moves are completed to a table over that language's
letters, or stay sorted where such a table would be large: where no longer match exists the phrase ends, is counted, and the next begins. So a text costs one look-up per
symbol and language, and many texts take each step together as one numpy operation.

Symbols are lower-cased letters; every run of anything else is one space. Letters that no sample has are
phrases of their own. Whole texts are parsed; a phrase also ends every ``BLOCK`` symbols, which lets one
long text be parsed in parallel and adds the same to every language.

The automata are fitted on a bounded sample of the labelled rows: per language ``fit_chars`` symbols of the ``fit_docs``
rows with the smallest hash, all cut to the same length, so that no language and no long text
outweighs others. Few or short rows are cut later, and more rows are read, until that many symbols are found. With many languages ``fit_chars`` shrinks so that all tables together stay bounded.

A null text, or one without a letter, is ``und`` with score 0. Without labelled rows everything is ``und``.
Repeated rows are judged alike, each for itself. Empty tables give empty results. Other columns pass
through; columns that bear a result's name are replaced. ``readable`` is false for ``und`` and for texts of 20
symbols or more whose phrases are, even in the best language, as short as those of random letters.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.llm.frames import add_columns, crc_mod, table
from quillrank.llm.registry import query

FIT_DOCS = 80
FIT_CHARS = 20_000
FIT_TOTAL = 400_000
BLOCK = 256
SHORTEST_PHRASE = 2.2
DENSE = 4_000_000  # entries of a completed table
SPACE, OTHER = 0, 1  # the first two symbols; the letters of the samples follow, then padding

ADDED = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("readable", T.BooleanType()),
    ]
)


def letters(text: str) -> str:
    """Lower-cased letters, every run of anything else one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def automaton(text: list[int]) -> list[dict[int, int]]:
    """Moves of the suffix automaton of ``text``; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for symbol in text:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and symbol not in moves[p]:
            moves[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = moves[p][symbol]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(symbol) == q:
                    moves[p][symbol] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


class Parser:
    """Moves by state and symbol, completed: entry = next state * 4 + phrases that end here."""

    def __init__(self, text: list[int], size: int):
        moves = automaton(text)
        self.size = size
        start = np.full(size, -1, np.int64)
        start[list(moves[0])] = list(moves[0].values())
        # No longer match: one phrase ends. An unknown letter is one more phrase.
        self.missed = np.where(start >= 0, start * 4 + 1, 2)
        keys = np.array([state * size + symbol for state, out in enumerate(moves) for symbol in sorted(out)], np.int64)
        to = np.array([out[symbol] for out in moves for symbol in sorted(out)], np.int64)
        self.dense = len(moves) * size <= DENSE
        if self.dense:
            table = np.tile(self.missed, (len(moves), 1))
            table[0] = 1
            table[:, -1] = np.arange(len(moves)) * 4  # padding changes nothing
            table.ravel()[keys] = to * 4
            # The next state is kept as the place of its row.
            self.moves = ((table >> 2) * size * 4 + (table & 3)).astype(np.int32).ravel()
        else:
            self.keys, self.to = np.append(keys, np.iinfo(np.int64).max), np.append(to * 4, 0)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        if self.dense:
            return self.moves[state + symbol]
        key = state.astype(np.int64) * self.size + symbol
        at = np.searchsorted(self.keys, key)
        entry = np.where(self.keys[at] == key, self.to[at], np.where(state == 0, 1, self.missed[symbol]))
        return np.where(symbol == self.size - 1, state.astype(np.int64) * 4, entry)


class Languages:
    """The tables of all languages and the symbol of every character."""

    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        alphabet = sorted({c for s in samples.values() for c in s if c != " "})
        number = {c: k + 2 for k, c in enumerate(alphabet)}
        self.size = len(alphabet) + 3
        self.tables: list[tuple[np.ndarray, Parser]] = []
        for name in self.names:
            own = sorted(set(samples[name]) - {" "})
            local = {c: k + 2 for k, c in enumerate(own)} | {" ": SPACE}
            to_local = np.full(self.size, OTHER, np.int32)
            to_local[SPACE], to_local[-1] = SPACE, len(own) + 2
            to_local[[number[c] for c in own]] = np.arange(len(own)) + 2
            text = [SPACE, *(local[c] for c in samples[name]), SPACE]
            self.tables.append((to_local, Parser(text, len(own) + 3)))
        self.symbol = np.full(0x110000, SPACE, np.int32)
        for point in range(sys.maxunicode + 1):
            c = chr(point)
            if c.isalpha():
                low = c.lower()
                self.symbol[point] = number.get(low if len(low) == 1 else low[0], OTHER)

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all texts, each text between spaces, and how many each has."""
        data = np.frombuffer((" " + " ".join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        symbols = self.symbol[data]
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] != SPACE) | (symbols[:-1] != SPACE)
        starts = np.cumsum(lengths) - lengths
        keep[starts] = True
        upto = np.concatenate([[0], np.cumsum(keep)])
        return symbols[keep], upto[starts + lengths] - upto[starts]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts x languages) phrases, the symbols of each text, and whether it has a letter."""
        symbols, counts = self.symbols(texts)
        blocks = -(-counts // BLOCK)
        first = np.concatenate([[0], np.cumsum(blocks)])
        begin = np.cumsum(counts) - counts
        owner = np.repeat(np.arange(len(texts)), blocks)
        within = np.arange(first[-1]) - first[owner]
        matrix = np.full((first[-1], BLOCK), self.size - 1, np.int32)
        place = np.arange(len(symbols)) - np.repeat(begin, counts)
        matrix[np.repeat(first[:-1], counts) + place // BLOCK, place % BLOCK] = symbols
        steps = np.ascontiguousarray(matrix.T)
        del matrix, place, within
        out = np.zeros((len(texts), len(self.names)), np.int64)
        for k, (to_local, parser) in enumerate(self.tables):
            row = np.zeros(first[-1], np.int32)
            ended = np.zeros(first[-1], np.int32)
            for symbol in to_local[steps]:
                entry = parser.step(row, symbol).astype(np.int32, copy=False)
                ended += entry & 3
                row = entry >> 2
            out[:, k] = np.bincount(owner, ended + (row > 0), minlength=len(texts))
        lettered = np.bincount(np.repeat(np.arange(len(texts)), counts), symbols != SPACE, minlength=len(texts)) > 0
        return out, counts, lettered

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        phrases, counts, lettered = self.phrases(texts)
        best = phrases.argmin(axis=1)
        least = phrases.min(axis=1)
        # One bit for each phrase more than the best language needs.
        score = np.where(lettered, 1 / np.exp2(np.maximum(least[:, None] - phrases, -60)).sum(axis=1), 0.0)
        readable = lettered & ((counts < 20) | (counts >= SHORTEST_PHRASE * least))
        return [self.names[b] if has else "und" for b, has in zip(best, lettered, strict=True)], score, readable


def groups(texts: list[str], size: int = 1_000_000):
    """Consecutive texts of about ``size`` characters together."""
    start, total = 0, 0
    for k, text in enumerate(texts):
        total += len(text)
        if total >= size:
            yield texts[start : k + 1]
            start, total = k + 1, 0
    if start < len(texts):
        yield texts[start:]


def learn(labelled: DataFrame, text: str, lang: str, key: str, fit_docs: int, fit_chars: int) -> Languages | None:
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key).alias("order"), F.xxhash64(text).alias("tie")
    )
    rows = rows.where(F.col("text").rlike(r"\p{L}"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order", "tie"))
    found: dict[str, list[str]] = {}
    most, cut, short = fit_docs, max(1, 4 * fit_chars // fit_docs), None
    while short is None or short:
        asked = rows if short is None else rows.where(F.col("lang").isin(short))
        sample = asked.withColumn("place", place).where(F.col("place") <= most)
        only = F.trim(F.regexp_replace("text", r"\P{L}+", " "))
        texts: dict[str, list[str]] = {}
        for row in sample.select("lang", "place", F.substring(only, 1, cut).alias("text")).orderBy("lang", "place").collect():
            texts.setdefault(row["lang"], []).append(letters(row["text"]))
        found |= texts
        # More may be found in further rows, or further on in rows that were cut.
        share = min(fit_chars, FIT_TOTAL // max(1, len(found)))
        short = [
            name
            for name, parts in texts.items()
            if sum(map(len, parts)) < share and ((len(parts) >= most and most < fit_chars) or max(map(len, parts)) >= cut - 1)
        ]
        most, cut = min(4 * most, max(most, fit_chars)), 4 * cut
    samples = {name: filled(parts, share, fit_docs) for name, parts in found.items()}
    samples = {name: sample for name, sample in samples.items() if sample.strip()}
    return Languages(samples) if samples else None


def filled(parts: list[str], share: int, least: int) -> str:
    """The first ``least`` parts, or as many as have ``share`` symbols, cut to one length so that about so many are left."""
    parts = parts[: min(share, max(least, int(np.searchsorted(np.cumsum([len(p) for p in parts]), share)) + 1))]
    left, level = share, 0
    for k, size in enumerate(sorted(map(len, parts))):
        level = left // (len(parts) - k)
        if size > level:
            break
        left -= size
    else:
        level = share
    return " ".join(part[:level] for part in parts)[: share + len(parts)]


def identify(
    docs: DataFrame,
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    fit_docs: int = FIT_DOCS,
    fit_chars: int = FIT_CHARS,
) -> DataFrame:
    """The documents with ``lang_pred``, ``score`` and ``readable``; ``labelled`` are the rows to learn from."""
    languages = learn(labelled, text, lang, key, fit_docs, fit_chars)
    if languages is None:
        nothing = {"lang_pred": F.lit("und"), "score": F.lit(0.0), "readable": F.lit(False)}
        return docs.withColumns(nothing)
    shared = docs.sparkSession.sparkContext.broadcast(languages)

    def kernel(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            names, scores, readable = [], [np.zeros(0)], [np.zeros(0, bool)]
            for part in groups(texts):
                predicted, score, fine = shared.value.predict(part)
                names += predicted
                scores.append(score)
                readable.append(fine)
            yield batch, [pa.array(names, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(readable))]

    return add_columns(docs, kernel, ADDED)


@query("op10_language_cross_parsing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = docs.select("doc_id", "text", "lang").where(F.coalesce(crc_mod("doc_id", 3), F.lit(0)) != 1)
    found = identify(docs.select("doc_id", "text"), labelled)
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
