"""Nearest neighbours and BM25 against brute force, also with copies and a hot group."""

import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillrank.operators import bm25
from quillrank.operators import knn
from quillrank.operators.knn import nearest


def vectors(spark, rows, columns):
    return spark.createDataFrame(rows, columns)


def test_nearest_is_exact_over_many_blocks_with_copies(spark, monkeypatch):
    monkeypatch.setattr(knn, "QUERY_BLOCK", 4)
    monkeypatch.setattr(knn, "ITEM_BLOCK", 16)
    rng = np.random.default_rng(3)
    items = rng.normal(size=(120, 6)).round(3)
    items[40:80] = items[0]  # a third of the items are copies of one
    asked = np.vstack([rng.normal(size=(10, 6)).round(3), items[:1]])
    frame = vectors(spark, [(i % 3, i, v.tolist()) for i, v in enumerate(items)], "book long, id long, embedding array<double>")
    queries = vectors(spark, [(q, v.tolist()) for q, v in enumerate(asked)], "query_id long, embedding array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(asked) @ unit(items).T, 9)

    found = nearest(queries, frame, 5, ["query_id"], ["book", "id"], within=["book"], ties=["id"]).collect()
    expected = set()
    for q in range(len(asked)):
        for book in range(3):
            ids = sorted(range(book, 120, 3), key=lambda i: (-scores[q, i], i))[:5]
            expected |= {(q, book, i, place + 1) for place, i in enumerate(ids)}
    assert {(r.query_id, r.book, r.id, r.pos) for r in found} == expected

    whole = nearest(queries, frame, 7, ["query_id"], ["book", "id"], ties=["id"]).collect()
    expected = set()
    for q in range(len(asked)):
        ids = sorted(range(120), key=lambda i: (-scores[q, i], i))[:7]
        expected |= {(q, i, place + 1) for place, i in enumerate(ids)}
    assert {(r.query_id, r.id, r.pos) for r in whole} == expected


def clustered(spark):
    rng = np.random.default_rng(8)
    heart = rng.normal(size=(12, 16))
    items = np.repeat(heart, 60, axis=0) + rng.normal(size=(720, 16)) * 0.03
    items[5] = 0  # without direction: scores 0 with everything
    asked = heart + rng.normal(size=heart.shape) * 0.03
    asked[3] = 0
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)] + [(999, None)], "id long, embedding array<double>")
    queries = spark.createDataFrame([(q, v.tolist()) for q, v in enumerate(asked)] + [(99, None)], "query_id long, embedding array<double>")
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    scores = np.round(unit(asked) @ unit(items).T, 9)
    want = {(q, i, n + 1) for q in range(12) for n, i in enumerate(sorted(range(720), key=lambda i: (-scores[q, i], i))[:9])}
    return frame, queries, want


def test_nearest_among_clusters_and_vectors_without_direction(spark, monkeypatch):
    frame, queries, want = clustered(spark)
    for items_of_a_block in (knn.ITEM_BLOCK, 100):  # one block, and bounds that meet across blocks
        monkeypatch.setattr(knn, "ITEM_BLOCK", items_of_a_block)
        found = nearest(queries, frame, 9, ["query_id"], ["id"], ties=["id"]).collect()
        assert {(r.query_id, r.id, r.pos) for r in found} == want


def test_few_exact_scores_are_taken_on_the_given_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    key, vector = vectors.columns[0], next(f.name for f in vectors.schema.fields if f.dataType.typeName() == "array")
    items = vectors.select(F.col(key).alias("id"), F.col(vector).alias("embedding"))
    queries = items.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    for k in (3, 8, 40):
        pairs = knn.possible(queries, items, k, ["query_id"], ["id"], [], ["id"]).count()
        assert k * queries.count() <= pairs < 0.05 * queries.count() * items.count()


def test_bytes_bound_the_exact_score():
    rng = np.random.default_rng(2)
    for width in (1, 3, 64, 300):
        rows = knn.unit(np.concatenate([rng.normal(size=(60, width)), np.eye(width)[:5], np.zeros((1, width))]))
        codes, scale, error = knn.in_bytes(rows)
        asked = knn.unit(rng.normal(size=(20, width)))
        near = (asked @ knn.rotation(width)) @ (codes * scale[:, None]).T
        assert (np.abs(near - asked @ rows.T) <= error + 1e-12).all()
        assert error.max() < 0.01 * max(1, np.sqrt(width / 50))


def test_inverted_lists_find_most_and_all_when_all_are_probed(spark, monkeypatch):
    monkeypatch.setattr(knn, "ITEMS_PER_LIST", 40)
    frame, queries, want = clustered(spark)
    exact = nearest(queries, frame, 9, ["query_id"], ["id"], ties=["id"])
    index = knn.Inverted(frame, ["id"])
    lists = len(index.centres)
    whole = index.search(queries, 9, ["query_id"], ["id"], probes=lists).collect()
    assert {(r.query_id, r.id, r.pos) for r in whole} == want
    some = knn.recall(index.search(queries, 9, ["query_id"], ["id"], probes=3), exact, ["query_id"], ["id"])
    rates = {r.query_id: r.recall for r in some.collect()}
    assert np.mean([rates[q] for q in range(12) if q != 3]) >= 0.9


def test_bm25_is_brute_force_with_and_without_a_stored_index(spark, tmp_path):
    rng = random.Random(5)
    common, rare = ["the", "of", "and"], [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(common, k=20) + rng.choices(rare, k=4)) for _ in range(150)]
    texts[100:] = [texts[0]] * 50  # a third of the passages are copies
    passages = spark.createDataFrame(
        [(i % 2, f"book{i % 2}", i, f"book:book{i % 2}", t) for i, t in enumerate(texts)],
        "book_ord long, book_id string, id long, subject string, content string",
    )
    asked = ["the of w1 w2", "the and of", "w3 The w3", "nothing here", ""]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    k = 6

    expected = {}
    words = [re.findall("[a-z0-9]+", t.lower()) for t in texts]
    for book in range(2):
        ids = range(book, 150, 2)
        mean = sum(len(words[i]) for i in ids) / len(ids)
        df = Counter(w for i in ids for w in set(words[i]))
        for q, text in enumerate(asked):
            scored = []
            for i in ids:
                tf, score = Counter(words[i]), 0
                for w in set(re.findall("[a-z0-9]+", text.lower())) & set(tf):
                    idf = math.log(1 + (len(ids) - df[w] + 0.5) / (df[w] + 0.5))
                    score += round(tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(words[i]) / mean)) * idf * 1e9)
                if score:
                    scored.append((-score, i))
            expected[q, book] = [i for _, i in sorted(scored)[:k]]

    def results(frame):
        found = {key: [] for key in expected}
        for r in frame.orderBy("pos").collect():
            found[r.query_id, r.book_ord].append(r.id)
        return found

    terms, postings = bm25.query_terms(queries), bm25.build_postings(passages)
    assert results(bm25.bm25_topk(terms, postings, k)) == expected
    path = str(tmp_path / "index")
    bm25.write_index(passages, path)
    stored = bm25.search_index(queries, path, k)
    assert results(stored) == expected
    assert "content" not in stored._jdf.queryExecution().toString()


def test_index_in_segments_reads_few_blocks_and_survives_changes(spark, tmp_path):
    from quillrank.operators.segments import Index

    rng = random.Random(11)
    common, rare = ["the", "of", "and"], [f"w{i}" for i in range(60)]

    def text():
        return " ".join(rng.choices(common, [9, 4, 1], k=rng.randint(5, 60)) + rng.choices(rare, k=4))

    schema = "book_ord long, id long, book_id string, subject string, content string"
    docs = {(i % 2, i): text() for i in range(700)}
    frame = lambda some: spark.createDataFrame([(b, i, f"b{b}", "s", t) for (b, i), t in some.items()], schema)
    queries = spark.createDataFrame(list(enumerate(["the w1 w2", "the of and", "w3 the w3", "nothing", ""])), "query_id long, text string")

    def want(docs, k):
        out = {}
        for book in range(2):
            words = {i: re.findall("[a-z0-9]+", t.lower()) for (b, i), t in docs.items() if b == book}
            mean = sum(map(len, words.values())) / len(words)
            df = Counter(w for x in words.values() for w in set(x))
            for r in queries.collect():
                scored = []
                for i, x in words.items():
                    tf, score = Counter(x), 0
                    for w in set(re.findall("[a-z0-9]+", r.text)) & set(tf):
                        idf = math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5))
                        score += math.floor(tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(x) / mean)) * idf * 1e9 + 0.5)
                    if score:
                        scored.append((-score, i))
                out |= {(r.query_id, book, n + 1): i for n, (_, i) in enumerate(sorted(scored)[:k])}
        return out

    def found(index, k):
        return {(r.query_id, r.book_ord, r.pos): r.id for r in index.search(queries, k).collect()}

    index = Index(spark, str(tmp_path / "index"))
    first = {key: t for key, t in docs.items() if key[1] < 500}
    index.add(frame(first))
    assert found(index, 5) == want(first, 5)
    index.add(frame({key: t for key, t in docs.items() if key[1] >= 500}))
    changed = {(0, 4): "w1 w2 w3", (1, 7): "the", (0, 900): "w1 the of"}
    index.add(frame(changed))  # two of them replace what is there
    index.remove(spark.createDataFrame([(0, 10), (1, 11), (1, 12_345)], "book_ord long, id long"))
    docs = {key: t for key, t in (docs | changed).items() if key not in ((0, 10), (1, 11))}
    assert found(index, 5) == want(docs, 5)
    read, every = index.read_blocks.count(), index.blocks().where("term IN ('the', 'of', 'and', 'w1', 'w2', 'w3')").count()
    assert read < 0.7 * every
    index.merge()
    assert index.manifest()[0][1] == "segment" and len(index.manifest()) == 1
    assert found(index, 5) == want(docs, 5)


def test_index_makes_no_rows_of_postings(spark, tmp_path, monkeypatch):
    from quillrank.operators import segments

    rng = random.Random(12)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(30)], range(1, 31), k=rng.randint(20, 60))) for _ in range(400)]
    texts[300:350] = [texts[0]] * 50  # ties are many
    rows = [(i % 2, f"book{i % 2}", i, "s", text) for i, text in enumerate(texts)] + [(0, "book0", 998, "s", None), (1, "book1", 999, "s", "")]
    passages = spark.createDataFrame(rows, "book_ord long, book_id string, id long, subject string, content string")
    asked = [" ".join(rng.choices([f"w{i}" for i in range(33)], k=6)) for _ in range(20)] + ["", "nothing", None, texts[0]]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    columns = ["query_id", "book_ord", "id", "pos", "score"]
    written = set()

    def noted(frame, name, of=segments.materialise):
        written.add(name)
        return of(frame, name)

    def want(passages):
        return sorted(map(tuple, bm25.bm25_topk(bm25.query_terms(queries), bm25.build_postings(passages), 7).select(*columns).collect()))

    monkeypatch.setattr(segments, "materialise", noted)
    monkeypatch.setattr(segments, "PART", 40, raising=False)
    monkeypatch.setattr(segments, "QUERY_BLOCK", 5, raising=False)
    index = segments.Index(spark, str(tmp_path / "index"))
    index.add(passages.where("id < 200").withColumn("content", F.concat("content", F.lit(" w1 w99"))))
    index.add(passages.where("id >= 100"))  # half of the first go
    index.add(passages.where("id < 100"))
    index.remove(passages.where("id % 9 = 4").select("book_ord", "id"))
    left = want(passages.where("id % 9 <> 4"))
    assert sorted(map(tuple, index.search(queries, 7).select(*columns).collect())) == left
    assert not {"postings", "partial"} & written  # rows of postings, and of scores of passages
    index.merge()
    assert sorted(map(tuple, index.search(queries, 7).select(*columns).collect())) == left


def test_bm25_in_blocks_is_the_pruned_search(spark, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(30)], range(1, 31), k=rng.randint(0, 40))) for _ in range(300)]
    texts[200:240] = [texts[0]] * 40  # ties are many
    rows = [(i % 3, f"book{i % 3}", i, "s", text) for i, text in enumerate(texts)] + [(0, "book0", 998, "s", None), (1, "book1", 999, "s", "")]
    passages = spark.createDataFrame(rows, "book_ord long, book_id string, id long, subject string, content string")
    asked = [" ".join(rng.choices([f"w{i}" for i in range(33)], k=6)) for _ in range(20)] + ["", "nothing", None, texts[0]]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    columns = ["query_id", "book_ord", "id", "pos", "score"]
    pruned = bm25.bm25_topk(bm25.query_terms(queries), bm25.build_postings(passages), 7).select(*columns)
    want = sorted(map(tuple, pruned.collect()))
    for items, asked_at_once in ((bm25.ITEM_BLOCK, bm25.QUERY_BLOCK), (20, 5)):
        monkeypatch.setattr(bm25, "ITEM_BLOCK", items)
        monkeypatch.setattr(bm25, "QUERY_BLOCK", asked_at_once)
        found = bm25.search(queries, passages, 7)
        assert sorted(map(tuple, found.select(*columns).collect())) == want
        assert {(r.book_id, r.subject) for r in found.collect()} == {(f"book{b}", "s") for b in range(3)}
        assert "Join" not in bm25.counted(passages)._jdf.queryExecution().optimizedPlan().toString()


def test_no_text_is_shuffled_to_its_vector(spark, monkeypatch):
    from quillrank import registry
    from quillrank.plans import retrieval

    registry.load_all()
    seen = []

    def noted(of):
        def run(first, passages, *rest, **named):
            seen.append(passages)
            return of(first, passages, *rest, **named)

        return run

    monkeypatch.setattr(retrieval.bm25, "search", noted(bm25.search))
    monkeypatch.setattr(retrieval, "fetch_payloads", noted(retrieval.fetch_payloads))
    for name in ("hybrid_search", "search_stages"):
        registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(seen) == 3
    seen += [registry.QUERIES[name](spark, "/root/testdata/sf0.001") for name in ("scan_passages", "citations", "section_title", "subject_key")]
    for frame in seen:
        assert "Join" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_only_words_that_a_query_has_are_written_and_shuffled(spark, monkeypatch):
    """``len`` and the counts of asked words stay as they are, whatever rows are counted together."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    rows = [(k % 3, k, "b", "s", " ".join(rng.choices(words, k=rng.choice([0, 5, 60])))) for k in range(90)] + [(0, 90, "b", "s", None)]
    passages = spark.createDataFrame(rows, "book_ord long, id long, book_id string, subject string, content string").coalesce(2)
    queries = spark.createDataFrame([(0, "w1 w2 W3"), (1, "w3 w4 w4 unknown"), (2, None)], "query_id long, text string")
    monkeypatch.setattr(bm25, "WORDS_AT_ONCE", 50)
    written, write = {}, bm25.materialise

    def noted(frame, name):
        written[name] = write(frame, name)
        return written[name]

    monkeypatch.setattr(bm25, "materialise", noted)
    columns = ["query_id", "book_ord", "id", "pos", "score"]
    found = sorted(map(tuple, bm25.search(queries, passages, 7).select(*columns).collect()))
    pruned = bm25.bm25_topk(bm25.query_terms(queries), bm25.build_postings(passages), 7)
    assert found == sorted(map(tuple, pruned.select(*columns).collect())) != []

    kept = {row.id: row for row in written["counted"].collect()}
    asked = {"w1", "w2", "w3", "w4"}
    assert len(kept) == len(rows)
    for _, number, _, _, text in rows:
        counts = Counter((text or "").split())
        terms = dict(zip(kept[number].terms, kept[number].tfs, strict=True))
        assert (kept[number].len or 0) == counts.total() and set(terms) <= set(counts)
        assert {w: n for w, n in terms.items() if w in asked} == {w: n for w, n in counts.items() if w in asked}
    assert sum(len(set(row.terms) - asked) for row in kept.values()) < 20


def shuffles_on_disk(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return sum(1 for name in str(manager.getAllBlocks().mkString("\n")).split("\n") if name.startswith("shuffle_") and name.endswith("_0.data"))


def test_a_table_leaves_no_shuffle_files(spark):
    """They stayed until the driver collected its garbage, so that those of all steps of a job lay on disk together."""
    from quillrank.sources.shared import materialise

    before = shuffles_on_disk(spark)
    table = materialise(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert table.count() == 7
    assert shuffles_on_disk(spark) <= before + 3  # those of count() above, which writes none


def met_by_many(spark, monkeypatch, module, name, run, attributes):
    """What ``run`` writes as ``name``, frame by frame, when queries come a few at a time."""
    seen = []
    write = module.materialise_each

    def noted(frames, table):
        def each():
            for frame in frames:
                if table == name:
                    seen.append(frame._jdf.queryExecution().optimizedPlan().toString())
                yield frame

        return write(each(), table)

    monkeypatch.setattr(module, "materialise_each", noted)
    for attribute, value in attributes.items():
        monkeypatch.setattr(module, attribute, value)
    found = run()
    return seen, found


def test_passages_and_items_are_not_shuffled_to_queries(spark, monkeypatch):
    """Each block of queries had its own copy of all passages and vectors in a shuffle: disk grew with queries times passages."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = [(i % 2, f"book{i % 2}", i, "s", " ".join(rng.choices(words, range(1, 61), k=rng.randint(1, 40)))) for i in range(200)]
    passages = spark.createDataFrame(rows, "book_ord long, book_id string, id long, subject string, content string")
    asked = [(q, " ".join(rng.choices(words, k=5))) for q in range(30)]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    columns = ["query_id", "book_ord", "id", "pos", "score"]
    pruned = bm25.bm25_topk(bm25.query_terms(queries), bm25.build_postings(passages), 4)
    want = sorted(map(tuple, pruned.select(*columns).collect()))
    sizes = {"QUERY_BLOCK": 7, "ITEM_BLOCK": 16, "COMMON_SHARE": 3}
    plans, found = met_by_many(spark, monkeypatch, bm25, "sparse", lambda: bm25.search(queries, passages, 4), sizes)
    assert sorted(map(tuple, found.select(*columns).collect())) == want
    assert len(plans) == 5
    assert not any("CoGroup" in plan or "Generate" in plan for plan in plans)

    points = np.random.default_rng(6).normal(size=(300, 8))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "id long, embedding array<double>")
    asked = items.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    run = lambda: nearest(asked, items, 3, ["query_id"], ["id"], ties=["id"])
    plans, found = met_by_many(spark, monkeypatch, knn, "met", run, {"QUERY_GROUP": 8, "QUERY_BLOCK": 3, "ITEM_BLOCK": 20})
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 9)
    assert {(r.query_id, r.id, r.pos) for r in found.collect()} == {
        (q, i, n + 1) for q in range(0, 300, 10) for n, i in enumerate(sorted(range(300), key=lambda i: (-scores[q, i], i))[:3])
    }
    assert len(plans) == 4
    assert not any("CoGroup" in plan or "Generate" in plan for plan in plans)


def test_bounds_let_no_pair_go_when_items_come_in_any_order(spark):
    """A scan that forgets pairs on its way, and copies that are scored once, leave the best of all."""
    rng = np.random.default_rng(12)
    points = np.repeat(rng.normal(size=(150, 8)), 4, axis=0)
    asked = knn.unit(rng.normal(size=(20, 8)))
    codes, scale, error = knn.in_bytes(knn.unit(points))
    scale, error = scale.astype(np.float32), np.nextafter(error.astype(np.float32), np.float32(np.inf)) + np.float32(knn.SLACK)
    scan = knn.Scan((asked @ knn.rotation(8)).astype(np.float32), 6)
    scan.limit = 50  # pruned again and again
    for first in range(0, 600, 100):
        part = slice(first, first + 100)
        scan.add(pa.table({"id": np.arange(600)[part]}), codes[part], scale[part], error[part])
    found = {(int(q), i) for query, items, _, _ in scan.results() for q, i in zip(query, items.column("id").to_pylist(), strict=True)}
    scores = asked @ knn.unit(points).T
    for q in range(20):
        kth = np.sort(scores[q])[-6]
        assert {(q, int(i)) for i in np.flatnonzero(scores[q] >= kth - 1e-12)} <= found
    assert len(found) < 0.2 * 20 * 600


def test_tables_that_only_a_search_reads_go_with_it(spark, monkeypatch):
    written = {}

    def noted(write):
        def run(frame, name):
            written[name] = write(frame, name)
            return written[name]

        return run

    monkeypatch.setattr(bm25, "materialise", noted(bm25.materialise))
    monkeypatch.setattr(knn, "materialise", noted(knn.materialise))
    passages = spark.createDataFrame([(0, "b", i, "s", f"a b{i}") for i in range(9)], "book_ord long, book_id string, id long, subject string, content string")
    assert bm25.search(spark.createDataFrame([(1, "a b3")], "query_id long, text string"), passages, 2).count() == 2
    items = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "id long, embedding array<double>")
    assert nearest(items.withColumnRenamed("id", "query_id"), items, 2, ["query_id"], ["id"], ties=["id"]).count() == 18
    exists = lambda frame: [name for name in frame.inputFiles() if Path(name.removeprefix("file:")).exists()]
    assert exists(written["counted"])
    assert not exists(written["in-order"]) and not exists(written["bytes"])


def written_by(spark, monkeypatch, name):
    """A query over whole requests, and the tables that its plan wrote, by name."""
    from quillrank import registry
    from quillrank.plans import answers

    registry.load_all()
    written = {}
    write = answers.materialise
    monkeypatch.setattr(answers, "materialise", lambda frame, table: written.setdefault(table, write(frame, table)))
    return registry.QUERIES[name](spark, "/root/testdata/sf0.001"), written


def test_sources_are_numbered_without_their_texts(spark, monkeypatch):
    """Texts of all found passages were written, and shuffled to be numbered, even for keys alone."""
    frame, written = written_by(spark, monkeypatch, "sources_concat")
    assert "numbered-sources" in written
    assert not [name for name, table in written.items() if "text" in table.columns or "content" in table.columns]
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan[: plan.index("_problem")]  # of a text stays whether it is there


def test_rankings_fetch_no_texts(spark, monkeypatch):
    frame, written = written_by(spark, monkeypatch, "rankings_text")
    assert not [name for name, table in written.items() if "text" in table.columns or "content" in table.columns]
    assert "documents.parquet" not in "".join(frame.inputFiles())
