"""Scalar functions on text, paths, ids, vectors and loose values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def slug(text, fallback: str = "item") -> Column:
    """Lower case with runs of other characters as one dash; the fallback when nothing is left."""
    made = F.regexp_replace(F.regexp_replace(F.lower(_c(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(F.coalesce(made, F.lit("")) == "", fallback).otherwise(made)


def safe_file_name(node_id) -> Column:
    """A node id as a file name: no separators, no parent steps."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(_c(node_id), r"[^A-Za-z0-9._-]", "-"), r"\.\.", "-"), r"^-+|-+$", "")


def display_id(node_id) -> Column:
    """The id without its type prefix."""
    return F.regexp_replace(_c(node_id), r"^[A-Za-z_]+:", "")


def initials(name) -> Column:
    """Upper-case first letters of the first two words."""
    words = F.filter(F.split(F.trim(_c(name)), r"[\s._-]+"), lambda w: w != "")
    return F.upper(F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.substring(w, 1, 1)), ""))


def shortened(text, n: int) -> Column:
    """Text of more than n characters cut to n with three dots at the end."""
    return F.when(F.length(_c(text)) > n, F.concat(F.substring(_c(text), 1, n - 3), F.lit("..."))).otherwise(_c(text))


def repository(url) -> Column:
    """struct(owner, repo) of a repository address."""
    path = F.regexp_replace(F.regexp_replace(_c(url), r"^(?:[a-z+]+://)?(?:[^@/]+@)?[^/:]+[/:]", ""), r"(?:\.git)?/*$", "")
    return F.struct(F.regexp_extract(path, r"^([^/]+)/", 1).alias("owner"), F.regexp_extract(path, r"^[^/]+/([^/]+)", 1).alias("repo"))


def normal_path(path) -> Column:
    """A path with '.' and empty steps dropped and '..' resolved; '..' at the start is dropped."""
    parts = F.filter(F.split(_c(path), "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        parts, F.array().cast("array<string>"), lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))
    )
    return F.array_join(folded, "/")


def clamp(value, low: float, high: float) -> Column:
    return F.when(_c(value).isNotNull(), F.least(F.greatest(_c(value), F.lit(low)), F.lit(high)))


def to_int(value, default: int = 0) -> Column:
    """A number or numeric text cut to an integer, else the default."""
    return F.coalesce(F.trim(_c(value).cast("string")).try_cast("double").try_cast("bigint"), F.lit(default)).cast("int")


def unit(value, default: float = 0.5) -> Column:
    """A number or numeric text kept within 0 and 1, else the default."""
    return F.coalesce(clamp(F.trim(_c(value).cast("string")).try_cast("double"), 0.0, 1.0), F.lit(default))


def first_truthy(*columns) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in columns])


def age(at, now) -> Column:
    """'3d', '5h' or '12m' between two timestamps."""
    minutes = F.floor((F.unix_timestamp(_c(now)) - F.unix_timestamp(_c(at))) / 60)
    return (
        F.when(minutes >= 1440, F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d")))
        .when(minutes >= 60, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h"))).otherwise(F.concat(minutes.cast("string"), F.lit("m")))
    )


def code_skeleton(code) -> Column:
    """Code without comments, with literals and numbers replaced and white space squeezed."""
    steps = [(r"//[^\n]*", ""), (r"/\*[\s\S]*?\*/", ""), (r'"[^"]*"', '"S"'), (r"'[^']*'", "'S'"), (r"`[^`]*`", "`S`"), (r"\b\d+(\.\d+)?\b", "N"), (r"\s+", " ")]
    out = _c(code)
    for pattern, to in steps:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def cosine(a, b) -> Column:
    """Cosine of two arrays; 0 when their lengths differ or one has no length."""
    x, y = (F.transform(_c(v), lambda e: e.cast("double")) for v in (a, b))
    add = lambda s, v: s + v
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), add)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda e: e * e), F.lit(0.0), add))
    size = norm(x) * norm(y)
    return F.when((F.size(x) != F.size(y)) | (size == 0) | _c(a).isNull() | _c(b).isNull(), 0.0).otherwise(dot / size)


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    if len(a) > len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(DoubleType())
def lcs_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Common subsequence over the longer length; two empty texts are equal, one empty text shares nothing."""

    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        longest = max(len(x), len(y))
        return 1.0 if longest == 0 else lcs_length(x, y) / longest

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")
