"""The audit stream against counting all orders plainly, whatever the order of files."""

import itertools
import re

import messy
import pytest

from quillrank.llm import filter_audit as fa

NAMES = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def fails(text, doc_id, least):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" if len(words) < 100 else ""
    out += "B" if 100 * len(set(words)) < 80 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else ""
    out += "D" if re.search(r"[#$%&*|]", text) else ""
    return out + ("E" if doc_id is not None and doc_id > least[text] else "")


def brute(rows, labels):
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    judged = [(part or "", fails(text or "", doc_id, least), *labels.get(doc_id, (0, 0))) for doc_id, text, part in rows]
    out = []
    for part in {p for p, *_ in judged}:
        own = [r[1:] for r in judged if r[0] == part]
        told, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for step, x in enumerate(order):
                before = set(order[:step])
                gone = [bool(before & set(f)) for f, _, _ in own]
                removed = [x in f and not g for (f, _, _), g in zip(own, gone, strict=True)]
                shapley[x] += sum(removed)
                counts = (
                    sum(not g and x not in f for (f, _, _), g in zip(own, gone, strict=True)),
                    sum(removed),
                    sum(g and x in f for (f, _, _), g in zip(own, gone, strict=True)),
                    sum(f == x for f, _, _ in own),
                    sum(r and q for r, (_, q, _) in zip(removed, own, strict=True)),
                    sum(r and t for r, (_, _, t) in zip(removed, own, strict=True)),
                )
                told.append((part, "".join(order), step + 1, *counts, x))
        out += [(*row[:-1], shapley[row[-1]]) for row in told]
    return sorted(out, key=lambda r: tuple(str(x) for x in r))


def rows():
    many = " ".join(f"word{k}" for k in range(120))
    found = [(i, t, None if k % 7 == 6 else f"l{k % 2}") for k, (i, t) in enumerate(messy.texts())]
    found += [(100 - k, many, "l0") for k in range(9)] + [(50, "LOUD #1", "l1"), (50, "LOUD #1", "l0"), (40, "LOUD #1", ""), (40, "LOUD #1", "l1"), (60, "LOUD #1", "l1")]
    return found + [(None, many, "l1"), (None, None, None), (-5, "", "l0")]


LABELS = [(0, 1, 0), (0, 0, 1), (40, 1, 1), (50, 0, 1), (92, 1, None), (95, None, 1), (None, 1, 1)]


@pytest.mark.parametrize("batches", [1, 5])
@pytest.mark.parametrize("backwards", [False, True])
def test_report_for_any_order_of_files(spark, tmp_path, batches, backwards):
    found = sorted(rows(), key=lambda r: (r[0] is None, r[0] or 0), reverse=backwards)
    schema = "doc_id long, text string, lang string"
    step = -(-len(found) // batches)
    for k in range(0, len(found), step):
        spark.createDataFrame([(*r, "x") for r in found[k : k + step]], f"{schema}, mask string").coalesce(1).write.parquet(f"{tmp_path}/docs/{k:04d}")
    stream = spark.readStream.schema(f"{schema}, mask string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/docs/*")
    labels = spark.createDataFrame([(*r, "k") for r in LABELS], "doc_id long, quality int, toxic int, key string")
    got = fa.audit(stream, labels)
    want = {i: (max(q or 0 for j, q, _ in LABELS if j == i), max(t or 0 for j, _, t in LABELS if j == i)) for i, _, _ in LABELS if i is not None}
    assert messy.by_row(got, *NAMES) == brute(rows(), want)


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    audit = fa.Audit(labels, str(tmp_path))
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    parts = [docs.where("doc_id >= 60"), docs.where("doc_id < 60 OR doc_id IS NULL")]
    audit.step(parts[0], 0)
    audit.step(parts[1], 1)
    once = messy.by_row(audit.counters(2), *fa.COUNTER, "n")
    audit.step(parts[1], 1)  # as after a failure before the commit
    assert messy.by_row(audit.counters(2), *fa.COUNTER, "n") == once
    taken = spark.read.parquet(f"{tmp_path}/changes/1").where("n < 0").count()
    assert taken > 0  # earlier masks were retracted


def test_empty_tables_and_lone_files(spark, tmp_path):
    messy.empty(spark).write.parquet(f"{tmp_path}/none.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    assert fa.audit(fa.as_stream(spark, f"{tmp_path}/none.parquet"), labels).count() == 0
    messy.documents(spark).coalesce(1).write.parquet(f"{tmp_path}/docs")
    lone = next((tmp_path / "docs").glob("*.parquet"))
    got = fa.audit(fa.as_stream(spark, str(lone)), labels.limit(0))
    assert got.count() == 600 * (messy.documents(spark).select("lang").distinct().count())
