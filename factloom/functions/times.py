"""Times in questions: an instant, a date, or an age such as ``72h`` or ``7d``."""

from __future__ import annotations

import datetime as dt
import re

_AGE = re.compile(r"^(\d+)(m|h|d|w)$")
_UNIT = {"m": "minutes", "h": "hours", "d": "days", "w": "weeks"}


def parse_when(text: str, now: dt.datetime) -> dt.datetime:
    """UTC without zone; an age counts back from ``now``, which is always given."""
    text = text.strip()
    if m := _AGE.match(text):
        return now - dt.timedelta(**{_UNIT[m[2]]: int(m[1])})
    try:
        t = dt.datetime.fromisoformat(text)
    except ValueError:
        raise ValueError(f"{text!r} is no time, date or age") from None
    return t.astimezone(dt.UTC).replace(tzinfo=None) if t.tzinfo else t


def canonical(t: dt.datetime) -> str:
    """UTC with six digits of fractions."""
    return t.strftime("%Y-%m-%dT%H:%M:%S.%f") + "Z"
