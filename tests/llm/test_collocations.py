"""Count automata against dictionaries, and collocations against plain counting."""

import random
import re
from collections import Counter

import messy
import numpy as np
import pyarrow as pa
import pytest

from quillrank.llm import automata, collocations


def counted(seed: int, n: int, width: int = 4) -> dict[tuple[int, ...], int]:
    rng = random.Random(seed)
    return {tuple(rng.choice([0, 1, 2, 3, 9]) for _ in range(rng.randint(1, width))): rng.choice([1, 1, 1, 7]) for _ in range(n)}


def arrays(counts: dict[tuple[int, ...], int], width: int = 5):
    rows = np.array([list(k) + [-1] * (width - len(k)) for k in sorted(counts)], np.int64).reshape(-1, width)
    return rows, np.array([counts[k] for k in sorted(counts)], np.int64)


def as_dict(rows, weights):
    return {tuple(int(x) for x in row if x >= 0): int(w) for row, w in zip(rows, weights, strict=True)}


@pytest.mark.parametrize("n", [0, 1, 3, 40, 400])
def test_automaton_holds_what_it_was_built_from(n):
    counts = counted(n, n)
    built = automata.Counts.of(*arrays(counts))
    assert as_dict(*built.rows(5)) == counts
    names = pa.array(["x", "", "é", "yy", "z"] + [f"w{k}" for k in range(5)])
    words, again = automata.Counts.unpack(built.pack(names.slice(0, 10)))
    assert as_dict(*again.rows(5)) == counts and words.equals(names)
    assert automata.Counts.unpack(built.pack(names.slice(3, 2)))[0].to_pylist() == ["yy", "z"]
    probes = np.array([[0, 1, 2, 3, 9], [9, 9, -1, -1, -1], [5, 0, 0, 0, 0], [3, -1, -1, -1, -1]])
    want = [[counts.get(tuple(p[: d + 1]), 0) if p[d] >= 0 else 0 for d in range(5)] for p in probes.tolist()]
    assert built.walk(probes).tolist() == want
    for a, b in zip(built.first[:-1], built.first[1:], strict=True):
        assert (np.diff(built.label[a:b]) > 0).all()


def test_equal_ends_are_one_state():
    ends = {(first, *rest): 1 for first in range(50) for rest in [(1,), (1, 2), (3, 4, 5)]}
    built = automata.Counts.of(*arrays(ends))
    assert as_dict(*built.rows(5)) == ends
    assert len(built.first) - 1 <= 6 and len(built.label) <= 56
    built = automata.Counts.of(*arrays({**ends, (7, 1, 2): 5}))
    assert as_dict(*built.rows(5)) == {**ends, (7, 1, 2): 5}


def test_union_adds_automata_with_words_of_their_own():
    words = [["b", "a", "ä"], ["c", "a"], ["z", "ä", "b"]]
    parts, want = [], Counter()
    for k, own in enumerate(words):
        counts = {key: c for key, c in counted(k, 30).items() if max(key) < len(own)}
        parts.append((pa.array(own), automata.Counts.of(*arrays(counts))))
        for key, c in counts.items():
            want[tuple(own[x] for x in key)] += c
    names, rows, weights = automata.union(parts, 5)
    names = names.to_pylist()
    assert names == sorted(names, key=str.encode)
    assert {tuple(names[x] for x in key): c for key, c in as_dict(rows, weights).items()} == want


def brute(rows, least, first):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", messy.lower(text)):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(words)
            for n in range(1, 6):
                for k in range(len(words) - n + 1):
                    key = (lang, tuple(words[k : k + n]))
                    counts[key] = counts.get(key, 0) + 1
    common = {k: a for k, a in counts.items() if a >= least}
    dropped = {
        (lang, w[i:j])
        for (lang, w), a in common.items()
        for i in range(len(w))
        for j in range(i + 2, len(w) + 1)
        if j - i < len(w) and 100 * a >= 100 * counts[lang, w[i:j]]
    }
    out = {}
    for (lang, w), a in common.items():
        if len(w) < 2 or (lang, w) in dropped:
            continue
        n = totals[lang]
        score, _, left, right = min((1000 * a * n // (counts[lang, w[:k]] * counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right, n))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, n, -s)
        for lang, found in out.items()
        for rank, (s, a, p, left, right, n) in enumerate(sorted(found)[:first], 1)
    )


def phrases(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "b", "new", "york", "city", "x y", "é", "a\x1cb"]
    seps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "; ", "\r\n", " ? "]
    return "".join(w + rng.choice(seps) for w in rng.choices(words, [9, 2, 5, 4, 4, 3, 3, 3, 1, 1, 1], k=n))


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 700, "range_words": 150, "group_rows": 4}])
def test_collocations_as_counted_plainly(spark, options):
    rows = [("en", phrases(k, 60)) for k in range(40)] + [(None, phrases(90, 300)), ("und", phrases(91, 300)), ("fr", "deux mots " * 400), ("fr", "seul"), ("xx", None), ("xx", "")]
    rows += [("en", phrases(5, 60))] * 3 + [("de", "the " * 2_000)] + [("en", t) for _, t in messy.texts()]
    docs = spark.createDataFrame([(k, lang, text, "x", "y", "z") for k, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, n string, phrase string, a string")
    got = collocations.collocations(docs, least=4, first=25, **options)
    assert messy.by_row(got, "lang", "rank", "phrase", "a", "l", "r", "n", "score") == sorted(brute(rows, 4, 25), key=lambda r: tuple(str(x) for x in r))


def test_no_rows_without_words(spark):
    assert collocations.collocations(messy.empty(spark)).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", ".,. \n"), ("en", "a b")], "lang string, text string")).count() == 0


def test_a_long_text_is_a_shard_of_its_own():
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 5 + ["fr"]), pa.array(["a b"] * 3 + ["c " * 5_000] + ["d", ""])], names=["lang", "text"])
    shards = list(collocations.shard_rows(iter([batch, batch]), 100))
    counts = Counter()
    for shard in shards:
        for row in shard.to_pylist():
            for w, c in zip(row["words"], row["counts"], strict=True):
                counts[row["lang"], w] += c
    assert counts == {("en", "a"): 6, ("en", "b"): 6, ("en", "c"): 10_000, ("en", "d"): 2}
