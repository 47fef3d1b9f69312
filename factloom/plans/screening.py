"""Screening of observations: each problem with its code and scope; what stays goes on to the fold.

A problem of scope ``observation`` rejects the whole row, one of scope ``claim`` only the claim, which
also uncovers the snapshots that would otherwise close what it spoke of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model.vocabulary import CORE_ONLY, IMPLICIT
from ..operators.validation import CANONICAL_TIME, CLAIM_CODES, KEY_PATTERN, duplicate_claims, overlapping_one, problems

OPEN = "9999-12-31 23:59:59.999999"


def _bad_key(k: Column) -> Column:
    return k.isNull() | ~k.rlike(KEY_PATTERN)


def claim_rows(decoded: DataFrame) -> DataFrame:
    """One row for each claim as it was sent: obs_id, part, pos, predicate, subject, object, json_type, text, vf, vt, ppm, absent, direction."""
    key = F.col("o.entity.key")
    none = F.lit(None).cast("string")
    variants = F.from_json(F.get_json_object("data", "$.entity.attributes"), "map<string,variant>")
    claims = F.from_json(F.get_json_object("data", "$.attribute_claims"), "array<struct<value:variant>>")

    def row(part, pos, predicate, subject, obj, kind, text, vf, vt, ppm, absent, direction, ended):
        return F.struct(
            F.lit(part).alias("part"), pos.cast("int").alias("pos"), predicate.alias("predicate"), subject.alias("subject"), obj.alias("object"), kind.alias("json_type"), text.alias("text"),
            vf.alias("vf"), vt.alias("vt"), ppm.cast("int").alias("ppm"), F.coalesce(absent, F.lit(False)).alias("absent"), F.lit(direction) .alias("direction") if isinstance(direction, str) else direction.alias("direction"), ended.alias("ended"),
        )

    no = F.lit(None)
    relation = lambda r, i: row(
        "relation", i, r["type"], F.when(r["to"].isNotNull(), key).otherwise(r["from"]), F.when(r["to"].isNotNull(), r["to"]).otherwise(key), none, none, r["valid_from"], r["valid_to"], r["confidence_ppm"], r["absent"],
        F.when(r["to"].isNotNull(), "OUT").otherwise("IN"), r["to"].isNotNull() != r["from"].isNotNull(),
    )
    typed = lambda v: F.when(v.isNull(), "VOID").otherwise(F.schema_of_variant(v))
    attribute = lambda e: row("attribute", F.lit(0), e["key"], key, none, typed(e["value"]), F.try_variant_get(e["value"], "$", "string"), none, none, no, F.lit(False), "OUT", F.lit(True))
    claim = lambda c, i: row("claim", i, c["predicate"], key, none, typed(F.get("variants", i)["value"]), F.try_variant_get(F.get("variants", i)["value"], "$", "string"), c["valid_from"], c["valid_to"], c["confidence_ppm"], c["absent"], "OUT", F.lit(True))
    d = decoded.where("NOT malformed").withColumn("variants", claims)
    rows = F.concat(F.transform(F.coalesce("o.relations", F.array()), relation), F.transform(F.coalesce(F.map_entries(variants), F.array()), attribute), F.transform(F.coalesce("o.attribute_claims", F.array()), claim))
    return d.select(F.col("id").alias("obs_id"), F.explode(rows).alias("c")).select("obs_id", "c.*")


def _instant(text: str, default: str | None) -> Column:
    t = F.try_to_timestamp(F.col(text)).cast("timestamp_ntz")
    return t if default is None else F.coalesce(t, F.lit(default).cast("timestamp_ntz"))


def screen(decoded: DataFrame, predicates: DataFrame, kinds: DataFrame, closure: DataFrame, key_kinds: DataFrame) -> DataFrame:
    """obs_id, part, pos, predicate, code, scope of every problem; one code per claim, the first that applies.

    ``decoded(id, source, time, observed_at, malformed, o, data)``, ``predicates(name, relation, type, cardinality,
    domain, range)``, ``kinds(name)``, ``closure(descendant, ancestor)``, ``key_kinds(key, kind)`` of other ends that are known.
    """
    whole = decoded.where("malformed OR time IS NULL").select(F.col("id").alias("obs_id"), F.lit("malformed").alias("code"))
    d = decoded.where("NOT malformed AND time IS NOT NULL")
    empty = F.array().cast("array<string>")
    directions = F.transform(F.coalesce("o.snapshots", F.array()), lambda s: F.coalesce(s["direction"], F.lit("")))
    head = d.select(
        F.col("id").alias("obs_id"), F.col("o.entity.kind").alias("kind"),
        (_bad_key(F.col("o.entity.key")) | F.exists(F.coalesce("o.entity.aliases", empty), _bad_key) | F.exists(F.coalesce("o.entity.linked_ids", empty), _bad_key) | F.exists(directions, lambda x: ~x.isin("IN", "OUT"))).alias("bad"),
    )
    known = kinds.select(F.col("name").alias("kind"), F.lit(True).alias("known"))
    head = head.join(F.broadcast(known), "kind", "left")
    of_entity = head.select("obs_id", F.when(F.col("bad"), "malformed").when(F.col("known").isNull() & (F.coalesce("kind", F.lit("")) != ""), "not_declared").alias("code")).where("code IS NOT NULL")

    rows = claim_rows(d)
    registry = predicates.select(F.col("name").alias("predicate"), F.col("relation").alias("is_relation"), F.col("type").alias("value_type"), "cardinality", "domain", "range", F.lit(True).alias("registered"))
    above = closure.groupBy("descendant").agg(F.collect_set("ancestor").alias("kinds"))
    own = d.select(F.col("o.entity.key").alias("key"), F.col("o.entity.kind").alias("kind")).unionByName(key_kinds.select("key", "kind")).groupBy("key").agg(F.max("kind").alias("kind"))
    own = own.join(F.broadcast(above.withColumnRenamed("descendant", "kind")), "kind", "left").select("key", "kinds")
    r = rows.join(F.broadcast(registry), "predicate", "left")
    r = r.join(own.toDF("subject", "subject_kinds"), "subject", "left").join(own.toDF("object", "object_kinds"), "object", "left")
    used = F.col("part") == "relation"
    registered = F.coalesce("registered", F.lit(False))
    outside = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.arrays_overlap(a, b)
    element = F.when(F.startswith(F.col("json_type"), F.lit("ARRAY<")), F.regexp_extract("json_type", r"^ARRAY<(.*)>$", 1)).otherwise(F.col("json_type"))
    many = F.col("cardinality") == "MANY"
    listed = F.startswith(F.coalesce("json_type", F.lit("")), F.lit("ARRAY"))
    number = element.isin("BIGINT", "DOUBLE", "FLOAT", "INT") | F.startswith(element, F.lit("DECIMAL"))
    fits = (
        F.when(F.col("value_type").isin("STRING", "TIME"), element.isin("STRING", "VOID")).when(F.col("value_type") == "FLOAT", number | (element == "VOID"))
        .when(F.col("value_type") == "BOOL", element.isin("BOOLEAN", "VOID")).otherwise(F.lit(True))
    )
    canonical = (F.col("value_type") != "TIME") | (F.col("json_type") != "STRING") | (F.col("text").rlike(CANONICAL_TIME) & F.try_to_timestamp("text").isNotNull())
    time_ok = lambda c: F.col(c).isNull() | F.try_to_timestamp(F.col(c)).isNotNull()
    checks = [
        ("malformed", ~F.col("ended") | (used & (_bad_key(F.col("subject")) | _bad_key(F.col("object")))) | F.coalesce(F.col("predicate"), F.lit("")).isin("", *IMPLICIT) | ((F.col("part") == "claim") & F.col("absent") & F.col("json_type").isin("VOID"))),
        ("malformed", ~time_ok("vf") | ~time_ok("vt")),
        ("core_predicate", F.col("predicate").isin(*CORE_ONLY)),
        ("not_declared", used & ~registered),
        ("type_mismatch", registered & (F.col("is_relation") != used)),
        ("cardinality_mismatch", ~used & listed & ~F.coalesce(many, F.lit(False)) & (F.coalesce("value_type", F.lit("")) != "JSON")),
        ("type_mismatch", ~used & registered & ~fits),
        ("invalid_value", (F.col("ppm").isNotNull() & ~F.col("ppm").between(1, 1_000_000)) | (~used & registered & ~canonical)),
        ("invalid_interval", _instant("vt", None) <= F.coalesce(_instant("vf", None), _instant("vt", None) - F.expr("INTERVAL '1' SECOND"))),
        ("domain_mismatch", used & outside("domain", "subject_kinds")),
        ("domain_mismatch", used & outside("range", "object_kinds")),
    ]
    found = r.withColumn("code", F.get(problems(checks), 0))
    of_claim = found.where("code IS NOT NULL").select("obs_id", "part", "pos", "predicate", "code")

    # one fact claimed twice in one observation
    fine = found.where("code IS NULL").withColumn("what", F.coalesce("object", F.concat_ws("\u0001", "json_type", "text"), F.lit("")))
    twice = duplicate_claims(fine.where("part <> 'attribute'"), ["obs_id", "subject", "predicate", "what"], ["vf", "vt", "ppm", "absent"])
    both = fine.where("part <> 'relation'").groupBy("obs_id", "subject", "predicate").agg(F.countDistinct("part").alias("parts")).where("parts > 1")
    dup = twice.select("obs_id").unionByName(both.select("obs_id")).distinct().select("obs_id", F.lit("duplicate_claim").alias("code"))
    at = d.select(F.col("id").alias("obs_id"), "observed_at")
    single = fine.where("cardinality = 'ONE' AND part <> 'attribute' AND NOT absent").join(at, "obs_id")
    single = single.select("obs_id", "subject", "predicate", "what", F.coalesce(_instant("vf", None), "observed_at").alias("vf"), _instant("vt", None).alias("vt"))
    overlap = overlapping_one(single, ["obs_id", "subject", "predicate"], "what").select("obs_id").distinct()
    overlap = overlap.join(dup.select("obs_id"), "obs_id", "left_anti").select("obs_id", F.lit("cardinality_mismatch").alias("code"))

    blank = lambda df: df.select("obs_id", F.lit(None).cast("string").alias("part"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("predicate"), "code")
    every = blank(whole).unionByName(blank(of_entity)).unionByName(of_claim).unionByName(blank(dup)).unionByName(blank(overlap))
    return every.withColumn("scope", F.when(F.col("code").isin(*CLAIM_CODES) & F.col("part").isNotNull(), "claim").otherwise("observation"))


def summary(found: DataFrame, most: int = 20) -> DataFrame:
    """Per observation its first problems as text, and how many more there are."""
    w = Window.partitionBy("obs_id").orderBy("part", "pos", "predicate", "code")
    rows = found.withColumn("n", F.row_number().over(w))
    line = F.concat_ws(" ", F.concat_ws(":", "part", F.col("pos").cast("string")), "predicate", "code")
    return rows.groupBy("obs_id").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") <= most, F.struct("n", line.alias("t"))))).getField("t"), "; ").alias("problems"), F.greatest(F.count("*") - most, F.lit(0)).alias("more"))


def kept(decoded: DataFrame, found: DataFrame) -> DataFrame:
    """Observations that no problem of their scope rejects."""
    return decoded.join(found.where("scope = 'observation'").select(F.col("obs_id").alias("id")).distinct(), "id", "left_anti")
