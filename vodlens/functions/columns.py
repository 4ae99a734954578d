"""Column builders (Column to Column): text, time, vectors and small statistics."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(c: Column) -> Column:
    """White-space separated words, without empty ones."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")


def index_tokens(c: Column) -> Column:
    """Search tokens: runs of a-z, 0-9 and _ of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))


def similarity_tokens(c: Column) -> Column:
    """The set of words of over one character, without punctuation, in any script."""
    plain = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s]", " ")
    return F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda w: F.length(w) > 1))


def collapse_runs(c: Column) -> Column:
    """Lower case, with each run of three or more of a character as one."""
    return F.regexp_replace(F.lower(c), r"(.)\1{2,}", "$1")


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def literal_map(values: Mapping[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def in_list(c: Column, values: Iterable[str]) -> Column:
    return c.isin(*values)


def any_contained(c: Column, values: Iterable[str]) -> Column:
    """Whether any of the values is a substring."""
    out = F.lit(False)
    for v in values:
        out = out | F.contains(c, F.lit(v))
    return out


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def sigmoid(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clamp(c, -50.0, 50.0)))


def clock(seconds: Column) -> Column:
    """MM:SS, or HH:MM:SS from an hour on."""
    s = F.floor(seconds).cast("long")
    short = F.format_string("%02d:%02d", F.floor(s / 60), s % 60)
    return F.when(s < 3600, short).otherwise(F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60))


def subtitle_clock(seconds: Column) -> Column:
    """H:MM:SS.cc."""
    c = F.round(seconds * 100).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(c / 360000), F.floor(c / 6000) % 60, F.floor(c / 100) % 60, c % 100)


def shorten(c: Column, size: int) -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def epoch_seconds(c: Column) -> Column:
    """Seconds from an epoch number in seconds, milli- or microseconds."""
    return F.when(c > 1e14, c / 1e6).when(c > 1e11, c / 1e3).otherwise(c)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def normalised(a: Column) -> Column:
    # The norm is bound as a lambda variable, or it would be computed anew for every component.
    return F.get(F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n == 0, x).otherwise(x / n))), F.lit(0))


def half_life(value: Column, days: Column, half: float = 14.0) -> Column:
    return value * F.pow(F.lit(2.0), -days / half)


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID (version 5) of a text, as text."""
    import uuid

    h = F.sha1(F.concat(F.unhex(F.lit(uuid.UUID(namespace).hex)), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def fuzzy_match(pattern: str, text: Column) -> Column:
    """Substring over squashed words, or a word that differs in at most one position or by one letter at the end."""
    import re

    bare = re.sub(r"[^\w]", "", pattern.lower())
    if not bare:
        return F.lit(False)
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s]", " ")
    squashed = F.regexp_replace(plain, r"(?U)\s", "")
    hit = F.contains(squashed, F.lit(bare))
    if len(bare) < 4:
        return hit
    n = len(bare)

    def near(w: Column) -> Column:
        diff = F.lit(0)
        for k, c in enumerate(bare):
            diff = diff + F.when((F.length(w) > k) & (F.substring(w, k + 1, 1) != c), 1).otherwise(0)
        return (F.abs(F.length(w) - n) <= 1) & (diff + F.abs(F.length(w) - n) <= 1)

    return hit | F.exists(words(plain), near)
