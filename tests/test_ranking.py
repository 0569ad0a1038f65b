"""Coverage ranking, clinical ranking and the ordered helpers on small cases with known results."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillrank.operators import clinical as cl
from quillrank.operators import repertory as rep
from quillrank.operators.ordered import rank_in_group, running_before
from quillrank.plans.repertorise import Repertorised, leading_remedies, remedy_rows

MATCH = "case_id long, symptom_ord long, rubric_ord long, book_id string, rubric_id string"
RUBRIC = "book_id string, id string, text string, remedies array<struct<remedy_id:string,grade:long>>"


def case(spark, symptoms, book="kent"):
    """Matches and rubrics of one case from [[(rubric, [(remedy, grade)…])…]…]."""
    matches = [(1, s, r, book, text) for s, rubrics in enumerate(symptoms) for r, (text, _) in enumerate(rubrics)]
    rubrics = {text: (book, text, text, remedies) for rubrics in symptoms for text, remedies in rubrics}
    m, r = spark.createDataFrame(matches, MATCH), spark.createDataFrame(list(rubrics.values()), RUBRIC)
    return m, r, remedy_rows(m, r)


def ranked(hits):
    return [(r.remedy_id, r.symptoms, r.grades) for r in rep.rank_remedies(hits).orderBy("rank").collect()]


def test_ranks_by_symptoms_then_grades(spark):
    _, _, hits = case(
        spark,
        [
            [("irritability", [("nux", 3), ("sulph", 1)])],
            [("thirstless", [("puls", 3), ("sulph", 1)])],
            [("waking", [("nux", 1), ("sulph", 2)])],
        ],
    )
    assert ranked(hits) == [("sulph", 3, 4), ("nux", 2, 4), ("puls", 1, 3)]


def test_counts_a_remedy_once_per_symptom(spark):
    _, _, hits = case(spark, [[("pain", [("bry", 1)]), ("pain, rising", [("bry", 3)])]])
    assert ranked(hits) == [("bry", 1, 3)]


@pytest.mark.parametrize(
    ("symptoms", "covered", "expected"),
    [
        (1, [1, 1, 1, 1, 1], False),
        (7, [3, 3, 3, 3, 3, 2], False),
        (0, [], False),
        (1, [1, 1, 1, 1], True),
        (7, [3, 2, 2, 2, 2, 2], True),
        (6, [3, 3, 3, 3, 3, 3], True),
    ],
)
def test_decisive(spark, symptoms, covered, expected):
    rows = spark.createDataFrame(
        [(1, f"r{i}", c, c) for i, c in enumerate(covered)], "case_id long, remedy_id string, symptoms long, grades long"
    )
    counts = spark.createDataFrame([(1, symptoms)], "case_id long, case_symptoms long")
    assert rep.decisive(rows, counts).first()["decisive"] is expected


def test_distinct_matches(spark):
    rows = [
        (1, 0, 0, "kent", "sciatica"),
        (1, 1, 0, "kent", "sciatica"),
        (1, 2, 0, "kent", "night"),
        (1, 2, 1, "kent", "sciatica"),
        (1, 3, 0, "boericke", "sciatica"),
    ]
    found = rep.distinct_matches(spark.createDataFrame(rows, MATCH)).orderBy("symptom_ord").collect()
    assert [(r.symptom_ord, r.book_id, r.rubric_id) for r in found] == [
        (0, "kent", "sciatica"),
        (2, "kent", "night"),
        (3, "boericke", "sciatica"),
    ]


@pytest.mark.parametrize(
    ("scores", "kept"),
    [
        ([(4, 9), (3, 6), (3, 5), (3, 4)], 3),
        ([(4, 9), (3, 6)], 2),
        ([(2, 4), (2, 4), (2, 4)], 3),
        ([(4, 9), (3, 6), (3, 5), (3, 5)], 2),
        ([(4, 9), (3, 5), (3, 5), (3, 5), (3, 5)], 1),
        ([(3, 5), (3, 5), (3, 5), (3, 5)], 0),
    ],
)
def test_standing_out(spark, scores, kept):
    rows = [(1, f"remedy-{i}", s, g) for i, (s, g) in enumerate(scores)]
    covered = spark.createDataFrame(rows, "case_id long, remedy_id string, symptoms long, grades long")
    found = rep.standing_out(covered).orderBy("leader_ord").collect()
    assert [r.remedy_id for r in found] == [f"remedy-{i}" for i in range(kept)]


# Two symptoms. The second rubric of the first one grades birch higher than the first does; alder is in three.
GARDEN = [
    [("Leaf: yellow", [("alder", 2), ("birch", 1)]), ("Leaf: yellow, edges", [("birch", 2)]), ("Leaf: dry", [("alder", 1)])],
    [("Root: soft", [("cedar-red", 1), ("alder", 2)])],
]


def leading(spark, symptoms, first_source=1, covered=None):
    matches, rubrics, hits = case(spark, symptoms)
    books = spark.createDataFrame([("kent", "Kent", "K")], "book_id string, book_title string, author string")
    run = Repertorised(matches, hits, covered if covered is not None else rep.coverage(hits), None)
    remedies, sources = leading_remedies(run, rubrics, books, first_source)
    return (
        [(r.remedy_name, r.symptom_ord, r.number) for r in remedies.orderBy("leader_ord", "symptom_ord").collect()],
        [(r.section_title, r.text) for r in sources.orderBy("cited").collect()],
    )


def test_leaders_cite_their_best_rubric_of_each_symptom(spark):
    remedies, rubrics = leading(spark, GARDEN, 4)
    # Coverage: alder two symptoms, then birch (grade 2) before cedar (grade 1), with one each.
    assert [r[0] for r in remedies] == ["Alder", "Alder", "Birch", "Cedar red"]
    number = {(name, symptom): n for name, symptom, n in remedies}
    titles = {4 + k: title for k, (title, _) in enumerate(rubrics)}
    assert titles[number["Alder", 0]] == "Leaf: yellow" and titles[number["Birch", 0]] == "Leaf: yellow, edges"
    assert number["Alder", 1] == number["Cedar red", 1] and titles[number["Alder", 1]] == "Root: soft"
    assert dict(rubrics)["Root: soft"] == "Remedies and their grades: Alder (2), Cedar red (1)"
    assert "Leaf: dry" not in titles.values()


def test_cites_no_more_rubrics_than_it_may(spark):
    _, _, hits = case(spark, GARDEN)
    best = rep.best_rubrics(rep.standing_out(rep.coverage(hits)), hits)
    for cap in (1, 2, 9):
        found = rep.matched_symptoms(best, rep.number_rubrics(best, 1, cap=cap)).collect()
        assert len(found) == 4 and {r.number for r in found} - {None} == set(range(1, min(cap, 3) + 1))


def test_lists_the_leaders_of_a_long_rubric_first(spark):
    many = [(f"remedy-{i}", 3 if i == 44 else 1) for i in range(45)] + [("sulphur", 1)]
    covered = spark.createDataFrame([(1, "sulphur", 1, 1)], "case_id long, remedy_id string, symptoms long, grades long")
    _, rubrics = leading(spark, [[("Mind: anxiety", many)]], covered=covered)
    assert rubrics[0][1].startswith("Remedies and their grades: Sulphur (1), Remedy 44 (3), Remedy 0 (1), ")
    assert rubrics[0][1].endswith(", and 6 more")


def terms(spark, *rows):
    return spark.createDataFrame(list(rows), "text string, remedies array<string>")


def diseases(spark, *names):
    return spark.createDataFrame([(1, name) for name in names], "case_id long, disease string")


def brute_clinical(named, listed):
    """(matched terms, ranking) by sets: a term matches when its words are all among a disease's."""
    words = lambda text: {w.strip(",") for w in text.split()}
    matched = {t for t, _ in listed if any(words(t) <= words(d) for d in named)}
    popular, count, rarity = {}, {}, {}
    for term, remedies in listed:
        for r in remedies:
            popular[r] = popular.get(r, 0) + 1
            if term in matched:
                count[r] = count.get(r, 0) + 1
                rarity[r] = rarity.get(r, 0) + math.floor(1 / math.log(len(remedies) + 2) * 1e12 + 0.5)
    return matched, sorted(count, key=lambda r: (-count[r], -rarity[r], -popular[r], r))


def test_clinical_ranking_is_brute_force(spark):
    rng = random.Random(12)
    vocabulary = [f"word{chr(97 + k)}" for k in range(9)]
    names = {", ".join(rng.sample(vocabulary, rng.randint(1, 3))) for _ in range(14)}
    listed = [(name, sorted(rng.sample([f"r{k}" for k in range(7)], rng.randint(1, 5)))) for name in sorted(names)]
    for _ in range(3):
        named = [" ".join(rng.sample(vocabulary, rng.randint(2, 5))) for _ in range(2)]
        found = cl.matched_terms(diseases(spark, *named), terms(spark, *listed))
        matched, order = brute_clinical(named, listed)
        assert {r.term for r in found.collect()} == matched
        scored = cl.scores(cl.case_terms(found, terms(spark, *listed)))
        ranking = cl.ranking(scored, cl.popularity(terms(spark, *listed))).orderBy("rank").collect()
        assert [r.remedy_id for r in ranking] == order


def test_terms_keep_the_order_of_diseases_and_catalog(spark):
    listed = spark.createDataFrame([("zinc", ["x"], 0), ("amber", ["x"], 1), ("moss", ["x", "y"], 2)], "text string, remedies array<string>, term_ord long")
    named = spark.createDataFrame([(1, 0, "old moss"), (1, 1, "amber zinc moss")], "case_id long, disease_ord long, disease string")
    found = cl.case_terms(cl.matched_terms(named, listed), listed)
    leaders = spark.createDataFrame([(1, "x", 1)], "case_id long, remedy_id string, rank long")
    assert [r.term for r in cl.remedy_terms(leaders, found).orderBy("place").collect()] == ["moss", "zinc", "amber"]


@pytest.mark.parametrize(("tied", "lead", "decisive"), [(5, 1, False), (4, 1, True), (9, 2, True), (1, 1, True)])
def test_decisive_match(spark, tied, lead, decisive):
    rows = [(1, f"r{k}", lead, 5) for k in range(tied)] + [(1, "behind", lead - 1, 9)] * (lead > 1)
    scored = spark.createDataFrame(rows, "case_id long, remedy_id string, count long, rarity long")
    assert cl.decisive_match(scored).first()["decisive"] is decisive
    assert cl.decisive_match(scored.limit(0)).count() == 0


def test_rank_in_group_with_one_hot_group(spark):
    frame = spark.range(6000).select(
        F.when(F.col("id") % 3 > 0, F.lit(0)).otherwise(F.col("id")).alias("g"),
        (F.col("id") * 7 % 5).alias("n"),
        F.col("id").alias("name"),
    )
    found = {r.name: r["rank"] for r in rank_in_group(frame, ["g"], [("n", True)], [F.col("name").asc()]).collect()}
    hot = sorted((r for r in frame.collect() if r.g == 0), key=lambda r: (-r.n, r.name))
    assert [found[r.name] for r in hot] == list(range(1, len(hot) + 1))


def test_running_before_across_blocks(spark):
    frame = spark.range(1000).select(F.lit(1).alias("g"), F.col("id").alias("at"), (F.col("id") % 7).alias("v"))
    found = running_before(frame, ["g"], "at", F.col("v"), "before", block=64).orderBy("at").collect()
    total = 0
    for row in found:
        assert row.before == total
        total += row.v
