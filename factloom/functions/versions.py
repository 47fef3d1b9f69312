"""Version scalars: dotted versions, lower bounds of ranges, comparison. All in SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canon_language(s: Column) -> Column:
    s = F.lower(F.trim(s))
    return F.when(s == "golang", "go").when(s == "nodejs", "node").otherwise(s)


def parse_dotted(s: Column) -> Column:
    """``array<int>`` of a dotted version, or null.

    A leading v goes, ``+build`` is cut, a part x, X or * ends the version, any other part must be a number.
    """
    bare = F.regexp_replace(F.split_part(F.trim(s), F.lit("+"), F.lit(1)), "^[vV]", "")
    parts = F.split(bare, r"\.", -1)
    wild = F.transform(parts, lambda p: p.isin("x", "X", "*"))
    upto = F.when(F.exists(wild, lambda w: w), F.array_position(wild, True) - 1).otherwise(F.size(parts)).cast("int")
    kept = F.slice(parts, F.lit(1), upto)
    good = F.forall(kept, lambda p: p.rlike("^[0-9]{1,9}$"))
    return F.when(good & (upto > 0), F.transform(kept, lambda p: p.cast("int")))


def pad(a: Column, n: Column | int) -> Column:
    """``a`` with zeros up to n parts: arrays of equal length compare part by part."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.concat(a, F.array_repeat(F.lit(0), F.greatest(n - F.size(a), F.lit(0))))


def less(a: Column, b: Column) -> Column:
    n = F.greatest(F.size(a), F.size(b))
    return pad(a, n) < pad(b, n)


def same(a: Column, b: Column) -> Column:
    n = F.greatest(F.size(a), F.size(b))
    return pad(a, n) == pad(b, n)


_WIDE = 16


def _least(arrays: Column) -> Column:
    """The smallest version; parts beyond 16 do not take part in the order."""
    return F.array_min(F.transform(arrays, lambda a: F.struct(pad(a, _WIDE).alias("k"), a.alias("v"))))["v"]


def _most(arrays: Column) -> Column:
    return F.array_max(F.transform(arrays, lambda a: F.struct(pad(a, _WIDE).alias("k"), a.alias("v"))))["v"]


def range_lower_bound(s: Column) -> Column:
    """The lower bound of one range: the largest of its comparators' bounds; ``<``, ``<=``, ``!=`` say nothing."""
    # an operator may stand apart from its version
    tight = F.regexp_replace(F.trim(s), r"([<>=!~^]+)\s+", "$1")
    terms = F.filter(F.split(tight, r"[\s,]+"), lambda t: t != "")
    terms = F.filter(terms, lambda t: ~t.rlike("^(<|!=)"))
    bounds = F.transform(terms, lambda t: parse_dotted(F.regexp_replace(t, r"^(\^|~>|~=|~|===|==|=|>=|>)", "")))
    good = (F.size(bounds) > 0) & F.forall(bounds, lambda b: b.isNotNull())
    return F.when(good, _most(bounds))


def lower_bound(s: Column) -> Column:
    """The lower bound of alternatives parted by ``||``: every one must have a bound; the smallest counts."""
    bounds = F.transform(F.split(s, r"\|\|"), range_lower_bound)
    return F.when(F.forall(bounds, lambda b: b.isNotNull()), _least(bounds))


def text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda p: p.cast("string")), ".")


def version_less(a: Column, b: Column) -> Column:
    """Part-wise, what is no number counts 0 (manifests)."""
    numbers = lambda s: F.transform(F.split(s, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))
    return less(numbers(a), numbers(b))
