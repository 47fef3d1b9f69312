"""Text scalars: normalisation, capture patterns, two Jaro-Winkler flavours, canonical JSON."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(s: Column) -> Column:
    """Lower case; runs of ``-``, ``_`` and space become one space; trimmed."""
    return F.trim(F.regexp_replace(F.lower(s), "[-_ ]+", " "))


def capture(s: Column, pattern: str) -> Column:
    """What ``{name}`` of ``prefix{name}suffix`` stands for: at least one character, else null."""
    prefix, _, suffix = pattern.partition("{name}")
    fits = F.startswith(s, F.lit(prefix)) & F.endswith(s, F.lit(suffix)) & (F.length(s) > len(prefix) + len(suffix))
    return F.when(fits, F.substr(s, F.lit(len(prefix) + 1), F.length(s) - len(prefix) - len(suffix)))


def tail(key: Column) -> Column:
    """The text after the last ``/``."""
    return F.substring_index(key, "/", -1)


def jaro_winkler(a, b, *, whole_halves: bool) -> float:
    """Jaro-Winkler of two sequences; prefix of up to 4 counts 0.1 each from Jaro 0.7 on.

    ``whole_halves``: half the number of transposed characters is cut to an integer.
    """
    n, m = len(a), len(b)
    if n == 0 or m == 0:
        return 0.0
    reach = max(max(n, m) // 2 - 1, 0)
    taken = [False] * m
    left = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                left.append(x)
                break
    k = len(left)
    if k == 0:
        return 0.0
    right = [b[j] for j in range(m) if taken[j]]
    moved = sum(x != y for x, y in zip(left, right, strict=True))
    half = moved // 2 if whole_halves else moved / 2
    jaro = (k / n + k / m + (k - half) / k) / 3
    if jaro < 0.7:
        return jaro
    prefix = 0
    while prefix < min(4, n, m) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def _bytes(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    return jaro_winkler(a.encode(), b.encode(), whole_halves=True)


def _chars(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    return 1.0 if a == b else jaro_winkler(a, b, whole_halves=False)


def _jw_find(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(map(_bytes, a, b), dtype="float64")


def _jw_match(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(map(_chars, a, b), dtype="float64")


def jw_find(a: Column, b: Column) -> Column:
    """The flavour of Find: on bytes, transpositions halved as an integer."""
    return F.pandas_udf(_jw_find, "double")(a, b)


def jw_match(a: Column, b: Column) -> Column:
    """The matcher's flavour: on characters, transpositions halved as a float, equal strings 1."""
    return F.pandas_udf(_jw_match, "double")(a, b)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets, 0 when both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


# -- canonical JSON (RFC 8785) ------------------------------------------------------------------


def _number(x: float) -> str:
    if not math.isfinite(x):
        raise ValueError("not a finite number")
    if x == 0:
        return "0"
    sign, digits, exponent = ("-" if x < 0 else ""), *_shortest(abs(x))
    n = len(digits)
    if n <= exponent <= 21:
        return sign + digits + "0" * (exponent - n)
    if 0 < exponent <= 21:
        return f"{sign}{digits[:exponent]}.{digits[exponent:]}"
    if -6 < exponent <= 0:
        return f"{sign}0.{'0' * -exponent}{digits}"
    e = exponent - 1
    head = digits if n == 1 else f"{digits[0]}.{digits[1:]}"
    return f"{sign}{head}e{'+' if e >= 0 else '-'}{abs(e)}"


def _shortest(x: float) -> tuple[str, int]:
    mantissa, _, e = f"{x!r}".partition("e")
    whole, _, part = mantissa.partition(".")
    digits = (whole + part).lstrip("0")
    point = len(whole) + int(e or 0) - (len(whole + part) - len((whole + part).lstrip("0")))
    return digits.rstrip("0") or "0", point


_ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def canonical_json(value: object) -> str:
    """RFC 8785 text: keys by UTF-16 units, shortest numbers, the fewest escapes."""
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, int | float):
        return _number(float(value))
    if isinstance(value, str):
        value.encode()  # a lone surrogate is refused
        return '"' + "".join(_ESCAPES.get(c) or (f"\\u{ord(c):04x}" if c < " " else c) for c in value) + '"'
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be"))
        return "{" + ",".join(f"{canonical_json(k)}:{canonical_json(value[k])}" for k in keys) + "}"
    raise TypeError(type(value).__name__)


def _jcs(text: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        try:
            return None if t is None else canonical_json(json.loads(t))
        except ValueError:
            return None

    return text.map(one)


def jcs(text: Column) -> Column:
    """Canonical form of JSON texts; null for what is not JSON."""
    return F.pandas_udf(_jcs, "string")(text)


def clip_utf8(s: Column, most: int) -> Column:
    """At most ``most`` bytes of UTF-8, never a part of a character."""
    # a character has at most four bytes, so one of four cuts is whole
    cuts = [F.try_validate_utf8(F.substring(F.encode(s, "UTF-8"), 1, n).cast("string")) for n in range(most, max(-1, most - 4), -1)]
    return F.when(F.octet_length(s) <= most, s).otherwise(F.coalesce(*cuts))


def visible(s: Column) -> Column:
    """Control characters become spaces."""
    return F.regexp_replace(s, r"[\p{Cc}\p{Cf}]+", " ")


def snake_case(name: Column) -> Column:
    """``SyncRequested`` as ``sync_requested``: every capital after the first character begins a word."""
    return F.lower(F.regexp_replace(name, r"(?<!^)(\p{Lu})", "_$1"))


def event_type(name: Column, prefix: str, known: list[str], version: str = "v1") -> Column:
    """``<prefix>.<name in snake case>.<version>`` of a message that is an event (one of ``known``), else null."""
    return F.when(name.isin(known), F.concat(F.lit(f"{prefix}."), snake_case(name), F.lit(f".{version}")))


def short_name(value: Column, zero: Column) -> Column:
    """An enum value's name without its enum's prefix, in lower case; ``zero`` is the name of the value 0, which ends in UNSPECIFIED."""
    prefix = F.regexp_replace(zero, "UNSPECIFIED$", "")
    return F.lower(F.when(F.startswith(value, prefix), F.substring(value, F.length(prefix) + 1, F.length(value))).otherwise(value))
