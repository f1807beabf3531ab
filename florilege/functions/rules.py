"""Predicates over text: bibliography entries, noise, front and back matter, captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P
from .text import is_reference_heading, let, n_words, normalize_again, normalize_text

#: Why a sentence is noise, in the order in which the rules are tried.
REASONS = ("flag", "back_matter", "reference", "word_count", "digits", "caption", "numeric", "numbered_year", "publisher", "email", "symbols", "name_list")


def reference_features(s: Column) -> dict[str, Column]:
    """Of a normalised text: year, locator, list marker, citation vocabulary, author with initials."""
    return {"year": s.rlike(P.YEAR), "locator": s.rlike(P.LOCATOR), "marker": s.rlike(P.MARKER), "citation": s.rlike(P.CITATION), "author": s.rlike(P.AUTHOR)}


def _entry(s: Column, n: Column, digit: Column) -> Column:
    """Of a normalised text of n words. What a rule needs at least, and what is anchored, is tried before what scans the text."""
    f = reference_features(s)
    year = digit & f["year"]
    marker = digit & f["marker"]
    return (F.length(s) >= 8) & (
        ((f["author"] | marker) & (year | f["locator"] | f["citation"] | (marker & f["author"])))
        | (digit & s.rlike(P.NAME_YEAR))
        | (f["locator"] & ((n <= 12) | year | f["citation"]))
        | (year & f["citation"])
    )


def _bound(text: Column, normal: bool, f) -> Column:
    """f(normalised text, number of words, whether it has a digit), each computed once."""
    once = normalize_again(text) if normal else normalize_text(text)
    return let(once, lambda s: let(F.struct(n_words(s).alias("n"), s.rlike("[0-9]").alias("digit")), lambda x: f(s, x["n"], x["digit"])))


def is_reference_entry(text: Column, normal: bool = False) -> Column:
    """normal: the text was cut from a normalised one."""
    return _bound(text, normal, lambda s, n, digit: _entry(s, F.greatest(n, F.lit(1)), digit))


def _noise_tests(s: Column, n: Column, digit: Column, section: Column | None, flagged: Column | None) -> dict[str, Column]:
    digits = F.length(F.regexp_replace(s, "[^0-9]+", ""))
    numbers = lambda: F.size(F.regexp_extract_all(s, F.lit(P.NUMERIC), F.lit(0)))
    entry = _entry(s, F.greatest(n, F.lit(1)), digit)
    tests = (
        F.lit(False) if flagged is None else F.coalesce(flagged, F.lit(False)),
        s.rlike(P.BACK_MATTER),
        entry if section is None else is_reference_heading(F.coalesce(section, F.lit(""))) | entry,
        (n < 5) | (n > 90),
        digit & (digits / F.greatest(F.lit(1), F.length(s)) > 0.28),
        s.rlike(P.CAPTION),
        (n >= 5) & ~s.rlike(P.PREDICATE) & (numbers() >= 5),
        digit & s.rlike(P.NUMBERED_YEAR),
        s.rlike(P.PUBLISHER),
        s.contains("@") & s.rlike(P.EMAIL),
        s.rlike(P.SYMBOLS),
        (n < 14) & s.rlike(P.NAME_LIST),
    )
    return dict(zip(REASONS, tests, strict=True))


def noise_reason(text: Column, section: Column | None = None, flagged: Column | None = None, normal: bool = False) -> Column:
    """The first rule that rejects a sentence, or null where it is kept. normal: the text was cut from a normalised one."""

    def of(s: Column, n: Column, digit: Column) -> Column:
        (reason, test), *rest = _noise_tests(s, n, digit, section, flagged).items()
        out = F.when(test, reason)
        for reason, test in rest:
            out = out.when(test, reason)
        return out

    return _bound(text, normal, of)


#: Where only whether a rule rejects matters, cheap ones go first.
_CHEAP = ("word_count", "flag", "back_matter", "caption", "symbols", "name_list", "email", "digits", "numbered_year")


def is_noise(text: Column, section: Column | None = None, flagged: Column | None = None, normal: bool = False) -> Column:
    """Whether noise_reason() has a reason."""

    def of(s: Column, n: Column, digit: Column) -> Column:
        tests = _noise_tests(s, n, digit, section, flagged)
        names = [*_CHEAP, *(r for r in REASONS if r not in _CHEAP)]
        out = tests[names[0]]
        for name in names[1:]:
            out = out | tests[name]
        return out

    return _bound(text, normal, of)


def is_front_matter_line(text: Column, page_index: Column) -> Column:
    return let(normalize_text(text), lambda s: _front(s, page_index))


def _front(s: Column, page_index: Column) -> Column:
    meta = s.rlike(P.FRONT_VOCABULARY) | s.rlike(P.EMAIL) | s.rlike("(?i)^(?:article|research article|original article|algorithms?)$") | s.rlike("^\\s*©|(?i:all rights reserved)")
    return (page_index == 0) & ((s == "") | (~s.rlike(rf"(?i)^(?:abstract|introduction){P.B}") & meta))


def is_back_matter_line(text: Column) -> Column:
    return normalize_text(text).rlike(P.BACK_MATTER)


def is_table_caption(text: Column) -> Column:
    return normalize_text(text).rlike(P.TABLE_CAPTION)


def reference_pages(lines: DataFrame) -> DataFrame:
    """doc_id, page_index, is_reference of the pages of lines (doc_id, page_index, text): six lines or more, of which four, and enough, are bibliography entries or years.

    Blank lines and headings of bibliographies don't count.
    """
    read = lines.withColumn("_s", normalize_text(F.col("text")))
    content = (F.col("_s") != "") & ~is_reference_heading(F.col("_s"))
    n = read.groupBy("doc_id", "page_index").agg(
        F.count_if(content).alias("n"),
        F.count_if(content & is_reference_entry(F.col("_s"), normal=True)).alias("hits"),
        F.count_if(content & F.col("_s").rlike(P.YEAR)).alias("years"),
    )
    enough = (F.col("hits") / F.col("n") >= 0.28) | (F.col("years") / F.col("n") >= 0.45)
    return n.select("doc_id", "page_index", ((F.col("n") >= 6) & (F.col("hits") >= 4) & F.coalesce(enough, F.lit(False))).alias("is_reference"))
