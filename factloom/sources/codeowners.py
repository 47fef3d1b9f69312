"""Repositories: CODEOWNERS rules, owner keys, manifests and the runtimes they declare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.versions import version_less

_VERSION = r"^v?[0-9]+(\.[0-9xX*]+)*$|^lts/"


def strip_comment(line: Column) -> Column:
    """Without what follows ``#``, unless it is written ``\\#``."""
    return F.regexp_replace(F.regexp_replace(line, r"(?<!\\)#.*$", ""), r"\\#", "#")


def rules(files: DataFrame) -> DataFrame:
    """``files(..., text)`` with line (from 1), pattern, owners: section headers go, rules without owners stay."""
    keep = [c for c in files.columns if c != "text"]
    lines = files.select(*keep, F.posexplode(F.split("text", r"\r?\n")).alias("pos", "raw"))
    lines = lines.withColumn("clean", F.trim(strip_comment(F.col("raw")))).where("clean <> '' AND NOT clean RLIKE '^\\\\^?\\\\['")
    words = F.split("clean", r"\s+")
    return lines.select(*keep, (F.col("pos") + 1).alias("line"), words[0].alias("pattern"), F.slice(words, 2, 1_000_000).alias("owners"))


def owner_key(owner: Column) -> Column:
    """``@org/team`` and ``@user`` as keys; e-mail addresses have none."""
    name = F.lower(F.substr(owner, F.lit(2), F.length(owner)))
    return F.when(F.startswith(owner, F.lit("@")), F.when(F.contains(owner, F.lit("/")), F.concat(F.lit("github:team/"), name)).otherwise(F.concat(F.lit("github:user/"), name)))


def owner_rules(files: DataFrame, keep: list[str]) -> DataFrame:
    r"""One row for each rule and owner with a key; a rule without owners keeps a row with a null key."""
    r = rules(files)
    r = r.withColumn("unowned", F.size("owners") == 0).withColumn("owner", F.explode_outer("owners")).withColumn("owner_key", owner_key(F.col("owner")))
    return r.where("unowned OR owner_key IS NOT NULL").select(*keep, "line", "pattern", "owner_key", "unowned")


def go_mod(text: Column) -> Column:
    """The go directive's version, or the toolchain's where that is newer."""
    go = F.nullif(F.regexp_extract(text, r"(?m)^go[ \t]+([0-9][^\s/]*)", 1), F.lit(""))
    tool = F.nullif(F.regexp_extract(text, r"(?m)^toolchain[ \t]+go([0-9][^\s/]*)", 1), F.lit(""))
    return F.when(tool.isNotNull() & (go.isNull() | version_less(go, tool)), tool).otherwise(go)


def package_json(text: Column) -> Column:
    return F.nullif(F.trim(F.get_json_object(text, "$.engines.node")), F.lit(""))


def version_file(text: Column) -> Column:
    """First line that is neither blank nor comment, if it has at most 64 characters and looks like a version."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), F.trim), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    first = F.get(lines, 0)
    return F.when((F.length(first) <= 64) & first.rlike(_VERSION), first)


def pyproject(text: Column) -> Column:
    """``requires-python`` within ``[project]``."""
    section = F.regexp_extract(text, r"(?ms)^\[project\][ \t]*$(.*?)(?=^\[|\z)", 1)
    return F.nullif(F.regexp_extract(section, r"(?m)^requires-python[ \t]*=[ \t]*[\"']([^\"']*)[\"']", 1), F.lit(""))


def tool_versions(text: Column) -> Column:
    """Array of (tool, version): the first version of each line."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(strip_comment(x))), lambda x: x.rlike(r"\S\s+\S"))
    return F.transform(lines, lambda x: F.struct(F.split(x, r"\s+")[0].alias("tool"), F.split(x, r"\s+")[1].alias("version")))


def runtimes(parts: Column, unreadable: Column) -> Column:
    """Distinct declarations of all manifests; null (not sent) where one of them could not be read."""
    return F.when(~unreadable, F.array_distinct(F.filter(parts, lambda x: x["version"].isNotNull())))


def effective_file(*columns: str) -> Column:
    """The first of the places where the file was found."""
    return F.coalesce(*columns)


def push_matters(changed: Column, paths: list[str], commits: Column, most: int = 20) -> Column:
    """Whether a push may have changed one of ``paths``: unknown for ``most`` commits, so yes."""
    return (commits >= most) | F.exists(F.flatten(changed), lambda p: p.isin(paths))


def node_id(kind: str, number: Column) -> Column:
    """Text form of a numeric id: base64 of ``<digits>:<Kind><number>``."""
    return F.base64(F.encode(F.concat(F.lit(f"{len(kind):03d}:{kind}"), number.cast("string")), "UTF-8"))


def numeric_id(text: Column) -> Column:
    return F.regexp_extract(F.decode(F.unbase64(text), "UTF-8"), r"(\d+)$", 1).try_cast("bigint")
