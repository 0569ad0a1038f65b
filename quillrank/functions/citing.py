"""Source labels such as ``[3]``, ``[1, 2]`` and ``[2-4]`` in answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillrank.functions.fixed_values import CITATION_LABEL, MAX_CITED_RANGE


def _whole(text: Column) -> Column:
    # A number too long for a bigint is no source's number; it is dropped.
    return F.trim(text).try_cast("bigint")


def numbers_of(label: Column) -> Column:
    """The numbers of one label's list. A range that runs backwards or too far gives its start."""

    def part(text: Column) -> Column:
        ends = F.split(text, "[–-]")
        start, end = _whole(F.get(ends, F.lit(0))), _whole(F.get(ends, F.lit(1)))
        is_range = end.isNotNull() & (end >= start) & (end - start <= MAX_CITED_RANGE)
        none = F.array().cast("array<bigint>")
        return F.when(start.isNull(), none).when(is_range, F.sequence(start, end)).otherwise(F.array(start))

    return F.flatten(F.transform(F.split(label, ","), part))


def cited_numbers(answer: Column) -> Column:
    """The distinct source numbers an answer cites, in the order they appear."""
    labels = F.regexp_extract_all(answer, F.lit(CITATION_LABEL), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(labels, numbers_of)))


def listed_sources(answer: Column, count: Column) -> Column:
    """The numbers up to ``count`` that an answer cites, or all of them if it cites nothing at all."""
    cited = cited_numbers(answer)
    every = F.when(count >= 1, F.sequence(F.lit(1).cast("long"), count.cast("long"))).otherwise(
        F.array().cast("array<bigint>")
    )
    return F.when(F.size(cited) == 0, every).otherwise(F.filter(every, lambda n: F.array_contains(cited, n)))


def link_citations(answer: Column, count: Column) -> Column:
    """Labels as links to the sources that exist; a label that names none stays as it is.

    The text between the labels and the labels are two arrays that are joined in turn.
    """
    between = F.split(answer, CITATION_LABEL, -1)
    labels = F.regexp_extract_all(answer, F.lit(CITATION_LABEL), F.lit(0))

    def link(label: Column) -> Column:
        inner = F.substring(label, F.lit(2), F.length(label) - 2)
        exist = F.filter(numbers_of(inner), lambda n: (n >= 1) & (n <= count))
        links = F.transform(exist, lambda n: F.format_string("[%d](#source-%d)", n, n))
        return F.when(F.size(exist) > 0, F.array_join(links, "")).otherwise(label)

    linked = F.transform(labels, link)
    pieces = F.zip_with(between, linked, lambda text, label: F.concat(text, F.coalesce(label, F.lit(""))))
    return F.array_join(pieces, "")
