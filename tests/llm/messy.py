"""Small tables with what operators must bear: nulls, empty and long texts, repeats, odd characters, clashing columns."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, SCORE string, n_words string, ids string, _id string"


def prose(seed: int, n: int, sound: str = "the and tion ing er on at ha re st") -> str:
    rng = random.Random(seed)
    parts = sound.split()
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(words)


def texts() -> list[tuple[int | None, str | None]]:
    first = prose(1, 150)
    near = first.split()
    near[70] = "changed"
    long = prose(2, 4_000)
    passage = " ".join(long.split()[1_000:1_070])
    item = prose(3, 30)
    return [
        (0, first),
        (1, first),
        (2, " ".join(near)),
        (3, None),
        (4, ""),
        (5, "  \n\t \x0b "),
        (6, "word"),
        (7, "ha " * 2_500),
        (8, long),
        (9, prose(4, 80) + "\n" + passage + "\n" + prose(5, 80)),
        (0, first),
        (None, first),
        (12, "日本語 éà ß \u00a0 🙂 " + prose(6, 30)),
        (13, first.upper()),
        (14, prose(7, 40) + " " + item + " " + prose(8, 40)),
        (15, "ha " * 2_500 + "end"),
        (16, "one two three"),
        (17, "One  two\nTHREE"),
        (18, passage),
        (19, "x" * 20_000),
        (20, prose(9, 300, "que eau ment le ou ai") + "\n" + prose(9, 300, "que eau ment le ou ai")),
    ]


def documents(spark):
    rows = [(i, t, None if k == 6 else ("fr" if i == 20 else "en"), None if k == 5 else f"src{k % 2}", None, "a", "b", "c", "d") for k, (i, t) in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def benchmark(spark):
    return spark.createDataFrame([(1, prose(3, 30)), (2, "One two three"), (3, None), (4, ""), (10, prose(3, 30))], "item_id long, text string")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def by_row(frame, *names):
    """Rows as sorted tuples of the named columns."""
    return sorted((tuple(row[n] for n in names) for row in frame.collect()), key=lambda r: tuple(str(x) for x in r))
