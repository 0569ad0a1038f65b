"""Texts, citations, prompts and histories on known results."""

import pytest
from pyspark.sql import functions as F

from quillrank.functions import citing, network, paths, prompts, words
from quillrank.functions import fixed_values as fixed
from quillrank.operators import history as hist
from quillrank.operators import replies as rep


def value(spark, make, *args, kinds=None):
    """The value of an expression over one row of arguments."""
    names = [f"a{i}" for i in range(len(args))]
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds or ["string"] * len(args)))
    return spark.createDataFrame([tuple(args)], schema).select(make(*[F.col(n) for n in names]).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("group", "sections", "numbers", "title"),
    [
        ("Mind", ["Mind"], None, "Mind"),
        ("Symptoms", ["Mind", "Head"], None, "Symptoms: Mind; Head"),
        (None, ["Mind", "Head"], None, "Mind; Head"),
        (None, None, None, ""),
        ("Principles", [], [28, 29], "Principles: §§ 28–29"),
        ("Principles", [], [5], "Principles: § 5"),
        (None, ["Notes"], [3, 7], "Notes; §§ 3, 7"),
    ],
)
def test_section_title(spark, group, sections, numbers, title):
    kinds = ["string", "array<string>", "array<long>"]
    assert value(spark, paths.section_title, group, sections, numbers, kinds=kinds) == title


def test_term_words(spark):
    def found(text):
        return value(spark, words.term_words, text)

    assert found("Diarrhœa of infants") == found("infant diarrhoea")
    assert found("Pains in rectum") == ["pain", "rectum"]


def parsed(spark, parse, reply):
    rows = parse(spark.createDataFrame([(1, reply)], "id long, reply string"), "id").orderBy("ord").collect()
    return [r.item for r in rows]


def test_parse_symptoms(spark):
    reply = "I found these:\n10) Knee: stiff, mornings\n# __Cough__ dry\n• Skin: itching\n\n  none \nAppetite gone"
    assert parsed(spark, rep.parse_symptoms, reply) == ["Knee: stiff, mornings", "Cough dry", "Skin: itching", "Appetite gone"]
    assert parsed(spark, rep.parse_symptoms, "none...") == []
    many = [f"Back: ache {i}" for i in range(fixed.MAX_SYMPTOMS + 4)]
    assert parsed(spark, rep.parse_symptoms, "\n".join(many)) == many[: fixed.MAX_SYMPTOMS]
    long = parsed(spark, rep.parse_symptoms, "y" * (fixed.MAX_SYMPTOM_CHARS - 1) + "  tail")
    assert long == ["y" * (fixed.MAX_SYMPTOM_CHARS - 1)]
    assert parsed(spark, rep.parse_symptoms, "Eye: RED\nEar: buzzing\n- eye: red") == ["Eye: RED", "Ear: buzzing"]


def test_parse_diseases(spark):
    assert parsed(spark, rep.parse_diseases, "Named:\n3. diagnosis : gout\n* DISEASE: Croup\n__Ringworm__\ngout") == ["gout", "Croup", "Ringworm"]
    assert parsed(spark, rep.parse_diseases, " None ") == []
    assert parsed(spark, rep.parse_diseases, "No illness was mentioned\nNocturnal cramp") == ["Nocturnal cramp"]


@pytest.mark.parametrize(("reply", "kind"), [("- Question: yes", "question"), ("**question**", "question"), ("Questionable", "case"), ("a question", "case"), ("\n", "case")])
def test_parse_kind(spark, reply, kind):
    assert value(spark, words.parse_kind, reply) == kind


def test_a_failed_model_call_is_a_row_with_an_error(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string").coalesce(1)
    good = rep.model_replies(frame, "id", lambda asked: [t.upper() for t in asked]).orderBy("id").collect()
    assert [(r.reply, r.error) for r in good] == [("<CASE>\nA\n</CASE>", None), ("<CASE>\nB\n</CASE>", None)]

    def broken(asked):
        raise TimeoutError("late")

    assert {r.error for r in rep.model_replies(frame, "id", broken).collect()} == {"TimeoutError: late"}


def test_citations(spark):
    def cited(text):
        return value(spark, citing.cited_numbers, text)

    def linked(text, count):
        return value(spark, citing.link_citations, text, count, kinds=["string", "long"])

    assert cited("[6] before [2, 4-6] after [6]") == [6, 2, 4, 5]
    # Too long a range and one that runs backwards stand for their first number; a link is no label.
    assert cited("[3-90] [8–6] [12345678901234567890] [1](y)") == [3, 8]
    assert linked("[2–3] and [1,3]", 2) == "[2](#source-2) and [1](#source-1)"
    untouched = "[7] stays, so does [text](http://a.example) and [1](z)"
    assert linked(untouched, 5) == untouched
    kinds = ["string", "long"]
    for text, sources, listed in [("[2] [2-3]", 5, [2, 3]), ("nothing", 2, [1, 2]), ("[6]", 2, []), ("nothing", 0, [])]:
        assert value(spark, citing.listed_sources, text, sources, kinds=kinds) == listed


def test_short_texts(spark):
    assert value(spark, prompts.title_from, "  What   is\nPulsatilla? ") == "What is Pulsatilla?"
    assert len(value(spark, prompts.title_from, "x" * 100)) == 80
    assert value(spark, prompts.bounded_answer, "a" * 12_000 + "b") == "a" * 12_000 + "…"
    assert value(spark, prompts.bounded_summary, "s" * 5_000) == "s" * 3_999 + "…"
    assert value(spark, paths.remedy_name, "natrum-muriaticum") == "Natrum muriaticum"
    assert value(spark, paths.pad_index, 12345, kinds=["long"]) == "12345"
    assert value(spark, paths.pad_index, 7, kinds=["long"]) == "0007"
    assert value(spark, words.strip, "﻿  a b \n") == "a b"


@pytest.mark.parametrize(
    ("address", "key"),
    [
        ("203.0.113.7", "203.0.113.7"),
        ("2001:DB8:0:1::7", "2001:db8:0:1::/64"),
        ("2001:0db8:0000:0001:ffff:0000:0000:0001", "2001:db8:0:1::/64"),
        ("::1", "0:0:0:0::/64"),
        ("::ffff:203.0.113.7", "203.0.113.7"),
        ("fe80::1%eth0", "fe80::1%eth0"),
        ("direct", "direct"),
    ],
)
def test_client_key(spark, address, key):
    frame = spark.createDataFrame([(address,)], "a string")
    assert frame.select(network.client_key(F.col("a")).alias("k")).first()["k"] == key


def test_client_key_agrees_with_the_library(spark):
    import ipaddress
    import random

    rng = random.Random(4)
    texts = ["::", "::1", "1::", ":::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2::3", "g::1", "12345::", ""]
    texts += ["::ffff:1.2.3.4", "::FFFF:1.2.3.256", "64:ff9b::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "::ffff:1.2.3", "1.2.3.4", "fe80::1%eth0", ":1", "1:", "1:2", "::01.2.3.4"]
    for _ in range(80):
        groups = [format(rng.choice([0, 0, rng.randrange(65_536)]), rng.choice(["x", "X", "04x"])) for _ in range(8)]
        texts.append(":".join(groups))
        texts.append(str(ipaddress.IPv6Address(":".join(groups))))

    def key(text):
        try:
            parsed = ipaddress.IPv6Address(text) if ":" in text and "%" not in text else None
        except ValueError:
            parsed = None
        if parsed is None:
            return text
        if parsed.ipv4_mapped is not None:
            return str(parsed.ipv4_mapped)
        return ":".join(f"{int(g, 16):x}" for g in parsed.exploded.split(":")[:4]) + "::/64"

    frame = spark.createDataFrame([(t,) for t in [*texts, None]], "a string")
    for row in frame.select("a", network.client_key(F.col("a")).alias("k")).collect():
        assert row["k"] == (None if row["a"] is None else key(row["a"])), row


@pytest.mark.parametrize("line", ["-\u00a0item", "\u20031)\u00a0item", "- item", "\ufeff* item"])
def test_list_markers_before_wide_blanks(spark, line):
    frame = spark.createDataFrame([(line,)], "r string")
    assert frame.select(words.reply_lines(F.col("r")).alias("l")).first()["l"] == ["item"]


def test_one_bad_prompt_fails_alone(spark):
    def generate(asked):
        if any("bad" in text for text in asked):
            raise ValueError("no")
        return [text.upper() for text in asked]

    frame = spark.createDataFrame([(k, "bad" if k == 3 else f"case {k}") for k in range(6)], "k long, text string").coalesce(1)
    found = {r["k"]: (r["reply"], r["error"]) for r in rep.model_replies(frame, "k", generate, wrap=None).collect()}
    assert found[3] == (None, "ValueError: no")
    assert all(found[k] == (f"CASE {k}", None) for k in range(6) if k != 3)


def test_long_conversations_keep_all_turns(spark):
    history = spark.createDataFrame([(1, t, "user", f"t{t}") for t in range(30)], "c long, turn long, role string, text string")
    headers = spark.createDataFrame([(1, None)], "c long, summary string")
    text = prompts.conversation_text(history, "c", headers).first()["conversation"]
    assert text.split("\n") == [f"<user>t{t}</user>" for t in range(30)]


def test_confirmed_text(spark):
    kinds = ["array<string>", "array<string>"]

    def text(symptoms, diseases):
        return value(spark, prompts.confirmed_text, symptoms, diseases, kinds=kinds)

    both = text(["Mind: weeping", "Stomach: thirstless"], ["asthma", "eczema"])
    assert "<confirmed_symptoms>\nMind: weeping\nStomach: thirstless\n</confirmed_symptoms>\n\nThe user checked the diseases" in both
    assert "<confirmed_diseases>\nasthma\neczema\n</confirmed_diseases>" in both
    none = text(["Mind: weeping"], [])
    assert "confirmed none. Do not answer for any disease" in none and "confirmed_diseases" not in none
    assert text([], None) == "" and text(None, None) == ""


def test_ranking_blocks(spark):
    schema = "id long, leader_ord long, remedy_name string, matched_ord long, text string, number long"
    rows = [(1, 1, "Nux vomica", 1, "Sleep: waking", None), (1, 1, "Nux vomica", 0, "Mind: irritable", 2)]
    block = prompts.ranking_block(spark.createDataFrame(rows, schema), "id", "repertory_ranking", "b").first()["b"]
    assert block == "<repertory_ranking>\n1. Nux vomica: Mind: irritable [2]; Sleep: waking\n</repertory_ranking>\n"
    assert value(spark, prompts.rankings_text, None, None) == ""


def prompt(spark, max_chars, message="latest", conversation="", sources=()):
    schema = "id long, conversation string, message string, confirmed string, rankings string"
    asked = spark.createDataFrame([(1, conversation, message, "", "")], schema)
    parts = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(sources)], "id long, number long, part string")
    return prompts.generation_prompt(asked, parts, "id", max_chars).first()["prompt"]


def test_generation_prompt(spark):
    full = prompt(spark, 5_000, "And Sepia?", "<user>old</user>", ["[1] A\nx\n\n", "[2] B\ny\n\n"])
    assert "<user>old</user>\n<latest_user_message>And Sepia?</latest_user_message>\n</conversation>" in full
    assert "<source_excerpts>\n[1] A\nx\n\n[2] B\ny\n\n\n</source_excerpts>" in full
    assert "No relevant excerpts were found." in prompt(spark, 5_000)
    # The oldest of the conversation goes first; a quarter stays for the excerpts, whose last is cut.
    cut = prompt(spark, 2_000, "m", "o" * 3_000 + "END", ["[1] A\n" + "x" * 300 + "\n\n", "y" * 900, "z"])
    assert len(cut) == 2_000 and "END\n<latest" in cut and "y" in cut and "z" not in cut.split("<source_excerpts>")[1][:-100]
    assert len(prompt(spark, 2_000, "m" * 5_000, "old")) <= 2_000 + len(fixed.NO_EXCERPTS)


def test_compaction_prompt(spark):
    text = spark.createDataFrame([("a" * 500 + "END",)], "c string")
    limit = len(fixed.CONVERSATION_HEAD) + len(fixed.COMPACTION_TAIL) + 10
    kept = text.select(prompts.compaction_prompt(F.col("c"), limit).alias("p")).first()["p"]
    assert len(kept) == limit and "aEND\n</conversation>" in kept
    assert "END" not in text.select(prompts.compaction_prompt(F.col("c"), 10).alias("p")).first()["p"]


TURNS = "conv_id long, turn long, role string, text string"
REQUEST = "conv_id long, message string, summary string, answer string"


def advanced(spark, turns, answer, summary=None):
    frame = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(turns)], TURNS)
    exchange = spark.createDataFrame([(1, "New question?", summary, answer)], REQUEST)
    return [r.text for r in hist.advance_history(frame, exchange, "conv_id").orderBy("turn").collect()]


def test_advance_history(spark):
    old = [f"old {i}" for i in range(20)]
    assert advanced(spark, old, "answer") == [*old[2:], "New question?", "answer"]
    big = [c * 4_000 for c in "abcd"]
    answer = "answer " * 700
    assert advanced(spark, big, answer) == [*big[2:], "New question?", answer[:4_000].strip()]
    assert advanced(spark, big[:3], "answer", "s" * 3_990) == [*big[1:3], "New question?", "answer"]
    assert advanced(spark, [], "answer") == ["New question?", "answer"]


def test_search_query(spark):
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for t in range(7)]
    asked = spark.createDataFrame([(1, "the last one", None, None)], REQUEST)
    found = hist.search_query(spark.createDataFrame(turns, TURNS), asked, "conv_id").first()["query"]
    assert found.split("\n") == ["turn 4", "turn 6", "the last one"]
    kinds = ["string", "array<string>", "array<string>"]
    assert value(spark, hist.searched_text, "q", ["a", "b"], ["c"], kinds=kinds) == "a\nb\nc"
    assert value(spark, hist.searched_text, "q", [], None, kinds=kinds) == "q"


@pytest.mark.parametrize(("turns", "chars", "full"), [(16, 100, True), (14, 100, False), (2, 16_000, False), (3, 12_800, True)])
def test_should_compact(spark, turns, chars, full):
    def test(c, t):
        return hist.should_compact(c, t, fixed.MAX_HISTORY_CHARS, fixed.MAX_HISTORY_TURNS)

    assert value(spark, test, chars, turns, kinds=["long", "long"]) is full


def test_a_letter_beyond_ascii_ends_a_word_of_a_reply(spark):
    from quillrank.functions.words import parse_kind

    replies = spark.createDataFrame([(1, "Noñbosque\nnote\nNo"), (2, "Questionñ"), (3, "questions")], "reply_id long, reply string")
    found = rep.parse_diseases(replies.where("reply_id = 1"), "reply_id").collect()
    assert [r["item"] for r in found] == ["note"]
    kinds = replies.select("reply_id", parse_kind(F.col("reply")).alias("kind")).collect()
    assert {r["reply_id"]: r["kind"] for r in kinds if r["reply_id"] > 1} == {2: "question", 3: "case"}
