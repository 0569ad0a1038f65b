"""Words of terms and lines of replies, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillrank.functions import fixed_values as fixed

SPACE = r"(?U)[\s﻿]"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends; Spark's own trim removes only blanks."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def strip_end(text: Column) -> Column:
    return F.regexp_replace(text, rf"{SPACE}+$", "")


def singular(word: Column) -> Column:
    """A word without its plural ending, by the shape of the ending alone."""
    size = F.length(word)
    es = (size > 4) & F.endswith(word, F.lit("es")) & ~word.rlike("(ses|tes)$")
    s = (size > 3) & F.endswith(word, F.lit("s")) & ~word.rlike("(ss|is|us)$")
    return (
        F.when(es, F.substring(word, F.lit(1), size - 2)).when(s, F.substring(word, F.lit(1), size - 1)).otherwise(word)
    )


def term_words(text: Column) -> Column:
    """The distinct words of a term, whatever its spelling, plurals and word order; sorted."""
    plain = F.lower(text)
    for old, new in (("æ", "ae"), ("œ", "oe"), ("-", "")):
        plain = F.replace(plain, F.lit(old), F.lit(new))
    words = F.regexp_extract_all(plain, F.lit("[a-z]+"), F.lit(0))
    links = F.array(*[F.lit(word) for word in fixed.LINK_WORDS])
    kept = F.filter(words, lambda word: ~F.array_contains(links, word))
    return F.array_sort(F.array_distinct(F.transform(kept, singular)))


def clean_line(line: Column) -> Column:
    """A reply's line without its list marker and emphasis."""
    return strip(F.regexp_replace(F.regexp_replace(line, fixed.LIST_MARKER, ""), fixed.EMPHASIS, ""))


def kept_line(line: Column) -> Column:
    """Whether a cleaned line says something: no heading, no blank and no bare ``None``."""
    return (line != "") & ~F.endswith(line, F.lit(":")) & ~line.rlike(fixed.NONE_LINE)


def reply_lines(reply: Column) -> Column:
    """A reply's lines in order."""
    lines = F.transform(F.split(reply, "\n"), clean_line)
    return F.filter(lines, kept_line)


def cut(text: Column, chars: int) -> Column:
    return strip_end(F.left(text, F.lit(chars)))


def symptom_of(line: Column) -> Column:
    return cut(line, fixed.MAX_SYMPTOM_CHARS)


def disease_of(line: Column) -> Column:
    """A line as a disease, or NULL when it names none."""
    disease = cut(F.regexp_replace(line, fixed.DISEASE_LABEL, ""), fixed.MAX_DISEASE_CHARS)
    return F.when((disease != "") & ~disease.rlike(fixed.NO_LINE), disease)


def parse_kind(reply: Column) -> Column:
    """``question`` if the reply plainly says so, else ``case``."""
    return F.when(reply.rlike(fixed.QUESTION_REPLY), F.lit("question")).otherwise(F.lit("case"))
