"""Small keys and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def subject_key(book_id: Column, remedy_id: Column) -> Column:
    """A passage's remedy as ``remedy:<id>``, or its book as ``book:<id>`` when it has none."""
    return F.when(remedy_id.isNotNull(), F.concat(F.lit("remedy:"), remedy_id)).otherwise(
        F.concat(F.lit("book:"), book_id)
    )


def aphorism_label(numbers: Column) -> Column:
    """``§ 5``, ``§§ 28–29`` for a run of numbers, ``§§ 3, 7`` otherwise; NULL for none."""
    expected = F.transform(numbers, lambda x, i: F.get(numbers, F.lit(0)) + i)
    return (
        F.when(F.coalesce(F.size(numbers), F.lit(0)) <= 0, F.lit(None).cast("string"))
        .when(F.size(numbers) == 1, F.concat(F.lit("§ "), F.get(numbers, F.lit(0)).cast("string")))
        .when(
            numbers == expected.cast("array<bigint>"),
            F.concat(
                F.lit("§§ "), F.get(numbers, F.lit(0)).cast("string"), F.lit("–"), F.element_at(numbers, -1).cast("string")
            ),
        )
        .otherwise(F.concat(F.lit("§§ "), F.array_join(numbers.cast("array<string>"), ", ")))
    )


def section_title(group: Column, sections: Column, aphorisms: Column) -> Column:
    """Sections other than the group, then the aphorisms, after the group's name."""
    name = F.coalesce(group, F.lit(""))
    others = F.filter(F.coalesce(sections, F.array().cast("array<string>")), lambda s: s.isNotNull() & (s != name))
    label = aphorism_label(aphorisms)
    joined = F.array_join(F.concat(others, F.when(label.isNull(), F.array().cast("array<string>")).otherwise(F.array(label))), "; ")
    return (
        F.when((name != "") & (joined != ""), F.concat(name, F.lit(": "), joined))
        .when(name != "", name)
        .otherwise(joined)
    )


def remedy_name(remedy_id: Column) -> Column:
    """``Natrum muriaticum`` for ``natrum-muriaticum``: only the first letter is raised."""
    name = F.replace(remedy_id, F.lit("-"), F.lit(" "))
    return F.concat(F.upper(F.substring(name, 1, 1)), F.substr(name, F.lit(2)))


def citation_id(corpus: str, book_id: Column, chunk_id: Column) -> Column:
    return F.concat_ws("/", F.lit(corpus), book_id, chunk_id.cast("string"))


def pad_index(index: Column, width: int = 4) -> Column:
    """A message's document id: padded with zeros, and never cut when it is longer."""
    text = index.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))
