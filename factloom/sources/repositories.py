"""Repositories, teams and people of a code host as observations: payloads by DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codeowners import owner_rules

_PATHS = (".github/CODEOWNERS", "CODEOWNERS", "docs/CODEOWNERS")


def observation_id(key: Column, at: Column) -> Column:
    """``<key>@<time with six digits>``: sending the same state again is the same observation."""
    return F.concat_ws("@", key, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def _json_null(c: Column | str) -> Column:
    """A read, empty value is null (known to be empty); it is not left out."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.to_json(F.struct(F.nullif(c, F.lit("")).alias("v"))), F.lit("{}"))


def repositories(repos: DataFrame, files: DataFrame) -> DataFrame:
    """One row per repository: key, name, alias, attributes, owners, snapshot.

    ``repos(id, org, name, description, language, archived, topics, read_at)``, ``files(id, path, text)``: of the
    places of CODEOWNERS the first found counts. owners are null, and the approves_changes scope is
    left out, where the file could not be read (no row in ``files`` with a null text either).
    """
    rank = F.array_position(F.array(*map(F.lit, _PATHS)), F.col("path"))
    chosen = files.where(rank > 0).groupBy("id").agg(F.min_by("text", rank).alias("text"))
    owners = owner_rules(chosen.where("text IS NOT NULL"), ["id"]).where("owner_key IS NOT NULL").groupBy("id").agg(F.array_sort(F.collect_set("owner_key")).alias("owners"))
    r = repos.join(chosen.select("id", F.lit(True).alias("has_file"), F.col("text").isNotNull().alias("readable")), "id", "left").join(owners, "id", "left")
    readable = F.coalesce("readable", F.lit(True))
    empty = F.array().cast("array<string>")
    return r.select(
        F.concat(F.lit("github:repository/"), F.col("id").cast("string")).alias("key"), "name", F.concat_ws("/", F.lit("github:name"), F.lower("org"), F.lower("name")).alias("alias"),
        F.create_map(F.lit("description"), _json_null("description"), F.lit("language"), _json_null("language"), F.lit("archived"), F.col("archived").cast("string"), F.lit("topics"), F.to_json(F.coalesce("topics", empty))).alias("attributes"),
        F.when(readable, F.coalesce("owners", empty)).alias("approves_changes"), F.when(readable, F.array(F.lit("approves_changes"))).alias("snapshot_out"), "read_at",
    )


def teams(teams: DataFrame, members: DataFrame, children: DataFrame) -> DataFrame:
    """Inward member_of claims of teams: subject, object, role; a team whose child list was cut is refused (no rows).

    ``teams(slug, children_total)``, ``members(slug, login, role)``, ``children(slug, child)``.
    """
    n = children.groupBy("slug").agg(F.count("*").alias("n"))
    whole = teams.join(n, "slug", "left").where(F.coalesce("n", F.lit(0)) >= F.coalesce("children_total", F.lit(0))).select("slug")
    group = F.concat(F.lit("github:team/"), F.lower("slug")).alias("object")
    people = members.join(whole, "slug", "left_semi").select(F.concat(F.lit("github:user/"), F.lower("login")).alias("subject"), group, F.lower("role").alias("role"))
    nested = children.join(whole, "slug", "left_semi").select(F.concat(F.lit("github:team/"), F.lower("child")).alias("subject"), group, F.lit(None).cast("string").alias("role"))
    return people.unionByName(nested)


def people(users: DataFrame) -> DataFrame:
    """Persons, once each over all pages of ``users(login, name, emails)``."""
    u = users.groupBy(F.lower("login").alias("login")).agg(F.max("name").alias("name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("emails", F.array().cast("array<string>")))))).alias("verified_email"))
    return u.select(F.concat(F.lit("github:user/"), "login").alias("key"), F.lit("Person").alias("kind"), F.coalesce(F.nullif("name", F.lit("")), "login").alias("name"), "verified_email")


def triggers(deliveries: DataFrame, org: str, paths: tuple[str, ...] = _PATHS, most_commits: int = 20) -> DataFrame:
    """What to read again: (target, id, may_be_gone) of ``deliveries(event, action, org, id, branch, default_branch, commits, changed)``.

    Only the configured organisation's; a push only on the default branch if it may have touched one of ``paths``;
    a missing object means deleted only where the delivery says so.
    """
    own = deliveries.where((F.lower("org") == org.lower()) & F.col("event").isin("repository", "push", "team", "membership"))
    touched = (F.coalesce("commits", F.lit(0)) >= most_commits) | F.exists(F.coalesce("changed", F.array().cast("array<string>")), lambda p: p.isin(*paths))
    own = own.where((F.col("event") != "push") | ((F.col("branch") == F.col("default_branch")) & touched))
    target = F.when(F.col("event").isin("repository", "push"), "repository").otherwise("team")
    return own.groupBy(target.alias("target"), "id").agg(F.max((F.col("event") == target) & (F.coalesce("action", F.lit("")) == "deleted")).alias("may_be_gone"))
