"""Directories of people and groups: users with linked identities, memberships with periods, paged reads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Unstable(RuntimeError):
    """A source whose list kept changing, or whose cursor did not move: no completeness."""


def users(people: DataFrame, connections: DataFrame) -> DataFrame:
    """key, alias, emails, linked_ids of ``people(uuid, username, email)`` and ``connections(uuid, linked)``."""
    linked = connections.groupBy("uuid").agg(F.array_sort(F.collect_set("linked")).alias("linked_ids"))
    p = people.groupBy("uuid", "username").agg(F.array_sort(F.collect_set(F.lower("email"))).alias("emails")).join(linked, "uuid", "left")
    return p.select(F.concat(F.lit("dir:user/"), "uuid").alias("key"), F.concat(F.lit("dir:username/"), "username").alias("alias"), "emails", F.coalesce("linked_ids", F.array().cast("array<string>")).alias("linked_ids"))


def memberships(groups: DataFrame) -> DataFrame:
    """Inward member_of claims of ``groups(group, member, start, end, role)``; a malformed period bound is open."""
    bound = lambda c: F.try_to_timestamp(F.col(c)).cast("timestamp_ntz")
    return groups.select(
        F.concat(F.lit("dir:user/"), "member").alias("subject"), F.lit("member_of").alias("predicate"), F.concat(F.lit("dir:group/"), "group").alias("object"),
        bound("start").alias("vf"), bound("end").alias("vt"), F.when(F.col("role").isNotNull(), F.to_json(F.struct("role"))).alias("quals"),
    )


def nested(groups: DataFrame) -> DataFrame:
    """(child, parent) claims of ``groups(group, children)``."""
    return groups.select(F.concat(F.lit("dir:group/"), F.explode("children")).alias("subject"), F.lit("member_of").alias("predicate"), F.concat(F.lit("dir:group/"), "group").alias("object"))


def pages(read: Callable[[str | None], tuple[list[dict], str | None, int]], *, most: int = 1_000, restarts: int = 2) -> Iterator[list[dict]]:
    """Pages of a source: ``read(cursor)`` gives rows, the next cursor (None at the end) and the total.

    A total that changes between pages starts the read again, at last :class:`Unstable`; so is a cursor that
    does not move, or more than ``most`` pages.
    """
    for _ in range(restarts + 1):
        out, cursor, total, seen = [], None, None, set()
        while len(out) < most:
            rows, following, n = read(cursor)
            if total is not None and n != total:
                break
            total = n
            out.append(rows)
            if following is None:
                yield from out
                return
            if following in seen:
                raise Unstable("the cursor did not move")
            seen.add(following)
            cursor = following
        else:
            raise Unstable(f"more than {most} pages")
    raise Unstable("the list kept changing")
