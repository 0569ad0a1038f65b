from collections import Counter

import messy
import numpy as np
import pytest

from quillrank.llm.components import components
from quillrank.llm.parity_join import Bands, near_duplicates, op5, segment_keys


def brute(rows, size, percent):
    sets: dict = {}
    for k, (i, text) in enumerate(rows):
        w = messy.words(messy.lower(text))
        grams = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        sets[k] = grams
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders: dict = {}
    for k, grams in sets.items():
        for g in grams:
            holders.setdefault(g, []).append(k)
    for k, grams in sets.items():
        for other, both in Counter(j for g in grams for j in holders[g] if j < k).items():
            if rows[k][0] is None or rows[other][0] is None:
                continue
            if 100 * both >= percent * (len(grams) + len(sets[other]) - both):
                a, b = find(rows[k][0]), find(rows[other][0])
                parent[max(a, b)] = min(a, b)
    return sorted(((i, len(sets[k]), None if i is None else find(i)) for k, (i, _) in enumerate(rows)), key=lambda r: tuple(str(x) for x in r))


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_agrees_with_brute_force(spark, size, percent):
    got = near_duplicates(messy.documents(spark), words=size, percent=percent)
    assert messy.by_row(got, "doc_id", "n_shingles", "component_id") == brute(messy.texts(), size, percent)
    assert {"SCORE", "ids", "n_words", "source", "text"} <= set(got.columns)


def test_near_copies_whose_smallest_is_no_neighbour(spark):
    """Chains and two families of copies: links that a star around the smallest id would miss."""
    rng = np.random.default_rng(5)
    rows = []
    for family in range(3):
        base = messy.prose(100 + family, 260).split()
        for k in range(14):
            w = list(base)
            for at in rng.choice(len(w), size=int(rng.integers(0, 9)), replace=False):
                w[at] = f"new{rng.integers(1_000_000)}"
            rows.append((int(rng.permutation(10_000)[0]) * 10 + k, " ".join(w)))
        for _ in range(6):  # a chain, each a little further from the base
            base = base[4:] + [f"more{rng.integers(1_000_000)}" for _ in range(4)]
            rows.append((int(rng.permutation(10_000)[0]) * 10 + 9, " ".join(base)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert messy.by_row(near_duplicates(frame), "doc_id", "n_shingles", "component_id") == brute(rows, 4, 85)


def test_query_agrees_with_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert messy.by_row(op5(spark, sf), "doc_id", "n_shingles", "component_id") == brute(rows, 4, 85)


def test_empty_table(spark):
    assert near_duplicates(messy.empty(spark)).count() == 0


def test_linked_sets_share_a_key():
    """The pigeonhole: whatever elements differ, as many as a link allows, a key is shared in a common band."""
    rng = np.random.default_rng(3)
    for percent in (80, 85):
        bands = Bands(percent)
        for size in [1, 2, 3, 5, 6, 7, 9, 12, 20, 33, 60, 150, 400, 1_500] * 12:
            common = rng.integers(0, 2**63, size, dtype=np.uint64)
            a, b = set(common.tolist()), set(common.tolist())
            for _ in range(size):
                side, drop = rng.integers(2), rng.integers(2)
                target = (a, b)[side]
                before = set(target)
                if drop and len(target) > 1:
                    target.discard(next(iter(target)))
                else:
                    target.add(int(rng.integers(0, 2**63)))
                if 100 * len(a & b) < percent * len(a | b):
                    target.clear()
                    target.update(before)
            sizes = np.array([len(a), len(b)])
            grams = np.concatenate([np.sort(np.array(list(s), np.uint64)) for s in (a, b)])
            band = bands.of(sizes)
            keys = [set(), set()]
            for chosen, level in ((np.array([True, True]), band), (bands.also_below(sizes, band), np.maximum(band - 1, 0))):
                found, owner = segment_keys(grams, sizes, bands, chosen, level)
                for key, of in zip(found.tolist(), owner.tolist(), strict=True):
                    keys[of].add(key)
            assert keys[0] & keys[1], (size, sizes)


def test_components_of_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 140)] + [(200, 150), (5, 5)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert all(found[k] == 1 for k in range(1, 61)) and all(found[k] == 100 for k in range(100, 140)) and found[200] == 150
