"""Predicates and buckets over node columns; all are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import model


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def is_test_label(label) -> Column:
    """A label that ends like a test file of the script languages."""
    return F.coalesce(_c(label).rlike(r"\.(test|spec)\.[jt]sx?$"), F.lit(False))


def is_test_path(path) -> Column:
    return F.coalesce(_c(path).rlike(r"\.test\.|\.spec\.|__tests__"), F.lit(False))


def is_entry_point(path) -> Column:
    """A file whose stem is one of the usual starting points."""
    return F.coalesce(F.lower(_c(path)).rlike(r"(^|[/:])(index|main|app|server|cli)\.[^/.]+$"), F.lit(False))


def file_complexity(lines) -> Column:
    return F.when(_c(lines) < 50, "simple").when(_c(lines) < 200, "moderate").when(_c(lines).isNotNull(), "complex")


def symbol_complexity(lines) -> Column:
    return F.when(_c(lines) < 20, "simple").when(_c(lines) < 80, "moderate").when(_c(lines).isNotNull(), "complex")


def size_class(files) -> Column:
    return F.when(_c(files) < 50, "small").when(_c(files) < 200, "medium").otherwise("large")


def file_category(language) -> Column:
    return (
        F.when(_c(language).isin(*model.SOURCE_LANGUAGES), "source").when(_c(language).isin(*model.CONFIG_LANGUAGES), "config")
        .when(_c(language).isin(*model.DOCUMENT_LANGUAGES), "document").otherwise("other")
    )


def language_of(path) -> Column:
    """Language by the lower-cased extension, 'unknown' when it has none that is known."""
    table = F.create_map(*[F.lit(x) for pair in model.LANGUAGE_BY_EXTENSION.items() for x in pair])
    return F.coalesce(table[F.lower(F.regexp_extract(_c(path), r"(\.[^./]+)$", 1))], F.lit("unknown"))


def layer_of_path(path) -> Column:
    """The first layer whose pattern the lower-cased path matches, else 'general'. The patterns match inside words."""
    text = F.lower(F.regexp_replace(_c(path), r"\\", "/"))
    (first, pattern), *rest = model.LAYER_PATTERNS
    return reduce(lambda chain, x: chain.when(text.rlike(x[1]), x[0]), rest, F.when(text.rlike(pattern), first)).otherwise("general")


def layer_rank(layer) -> Column:
    (first, rank), *rest = model.LAYER_RANKS.items()
    return reduce(lambda chain, x: chain.when(_c(layer) == x[0], x[1]), rest, F.when(_c(layer) == first, rank))


def risk_tier(score, strict: bool = False, null_tier: str | None = None) -> Column:
    """high from 0.7 (above 0.7 when strict), medium from 0.4, else low; null gives null_tier."""
    s = _c(score)
    high = s > 0.7 if strict else s >= 0.7
    medium = s > 0.4 if strict else s >= 0.4
    return F.when(s.isNull(), F.lit(null_tier)).when(high, "high").when(medium, "medium").otherwise("low")


def grade(score) -> Column:
    return F.when(_c(score) >= 90, "A").when(_c(score) >= 80, "B").when(_c(score) >= 70, "C").when(_c(score) >= 60, "D").otherwise("F")
