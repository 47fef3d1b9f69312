"""Queries over everything that ingest derives, from one observation for each event of the driver's ``events``.

Event n of a user is an observation of ``app:user/u`` by the source web or api: its ``status`` is the kind of event (none
after an error), and its teams are one or two of seven, stated as a whole (a snapshot). Three neighbours share a mail key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model.declaration import Declaration, predicates_frame
from ..model.vocabulary import kind_closure, kinds_frame
from ..operators import temporal
from ..sources import observations
from . import answers, ingest, match_run, screening
from .driver_model import table
from .registry import query

_DERIVED: dict[tuple[str, str], ingest.Derived] = {}


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, source, seq, observed_at, data): the observations as JSON."""
    user, team = F.col("user_id").cast("string"), lambda n: F.concat(F.lit("app:team/"), F.pmod(F.col("event_id") + n, F.lit(7)).cast("string"))
    member = lambda n: F.struct(F.lit("member_of").alias("type"), team(n).alias("to"))
    entity = F.struct(
        F.lit("Person").alias("kind"), F.concat(F.lit("app:user/"), user).alias("key"), F.array(F.concat(F.lit("app:mail/"), F.floor(F.col("user_id") / 3).cast("string"))).alias("aliases"),
        F.struct(F.concat(F.lit("user "), user).alias("name"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("status")).alias("attributes"),
    )
    snapshot = F.array(F.struct(F.lit("OUT").alias("direction"), F.array(F.lit("member_of")).alias("predicates")))
    relations = F.when(F.col("event_id") % 3 == 0, F.array(member(0), member(1))).otherwise(F.array(member(0)))
    data = F.to_json(F.struct(entity.alias("entity"), relations.alias("relations"), snapshot.alias("snapshots")), {"ignoreNullFields": "false"})
    source = F.when(F.col("event_id") % 2 == 0, "web").otherwise("api")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("o"), F.col("event_id").cast("string")).alias("id"), source.alias("source"), F.col("event_id").alias("seq"), F.col("ts").alias("observed_at"), data.alias("data"))


def derived(spark: SparkSession, sf_dir: str) -> ingest.Derived:
    """Derived once for each session and folder: the tables are written, so several queries read them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _DERIVED:
        _DERIVED[key] = ingest.derive(spark, observations.decode(envelopes(spark, sf_dir)))
    return _DERIVED[key]


def _named(d: ingest.Derived, df: DataFrame, column: str) -> DataFrame:
    """``column`` holds records: name them by their own key (users and teams have one besides the mail key)."""
    own = d.alias.where(~F.startswith("key", F.lit("app:mail/"))).select(F.col("record").alias(column), F.col("key").alias(f"{column}_key"))
    return df.join(own, column, "left").drop(column).withColumnRenamed(f"{column}_key", column)


_OBS = """o AS (SELECT concat('o', CAST(event_id AS STRING)) AS id, CASE WHEN event_id % 2 = 0 THEN 'web' ELSE 'api' END AS source, event_id AS seq, ts AS at, concat('app:user/', CAST(user_id AS STRING)) AS key,
      user_id // 3 AS mail, CASE WHEN event_type <> 'error' THEN event_type END AS status, event_id FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY source, key ORDER BY seq) AS n FROM o),
    st AS (SELECT *, row_number() OVER (PARTITION BY source, key ORDER BY seq) - row_number() OVER (PARTITION BY source, key, status ORDER BY seq) AS run FROM n),
    sf AS (SELECT source, key, 'status' AS predicate, CAST(NULL AS STRING) AS object, status AS value, run, min(at) AS valid_from, max(n) AS last, count(*) AS n_support, min_by(id, (at, id)) AS first_id, max_by(id, (at, id)) AS last_id
      FROM st WHERE status IS NOT NULL GROUP BY source, key, status, run),
    tm AS (SELECT source, key, n, at, id, concat('app:team/', CAST(t AS STRING)) AS object FROM (SELECT *, unnest(CASE WHEN event_id % 3 = 0 THEN [event_id % 7, (event_id + 1) % 7] ELSE [event_id % 7] END) AS t FROM n)),
    ti AS (SELECT *, n - row_number() OVER (PARTITION BY source, key, object ORDER BY n) AS run FROM tm),
    tf AS (SELECT source, key, 'member_of' AS predicate, object, CAST(NULL AS STRING) AS value, run, min(at) AS valid_from, max(n) AS last, count(*) AS n_support, min_by(id, (at, id)) AS first_id, max_by(id, (at, id)) AS last_id
      FROM ti GROUP BY source, key, object, run),
    f AS (SELECT x.*, n.at AS valid_to FROM (SELECT * FROM sf UNION ALL SELECT * FROM tf) x LEFT JOIN n ON n.source = x.source AND n.key = x.key AND n.n = x.last + 1)"""


@query(f"WITH {_OBS} SELECT source, key AS subject, predicate, object, value, valid_from, valid_to, n_support FROM f")
def ingest_facts(spark, sf_dir):
    d = derived(spark, sf_dir)
    facts = _named(d, _named(d, d.facts.select("source", "subject", "predicate", "object", "value", "valid_from", "valid_to", "n_support"), "subject"), "object")
    return facts.select("source", "subject", "predicate", "object", "value", "valid_from", "valid_to", "n_support")


@query(f"WITH {_OBS} SELECT key AS subject, predicate, object, value, valid_from, source, first_id, last_id, n_support AS source_count FROM f")
def ingest_fact_sources(spark, sf_dir):
    d = derived(spark, sf_dir)
    seen = envelopes(spark, sf_dir).select("id", "source", "observed_at")
    found = temporal.first_and_last_sources(d.fact_source, seen).join(d.facts.select(F.col("id").alias("fact_id"), "subject", "predicate", "object", "value", "valid_from"), "fact_id")
    return _named(d, _named(d, found, "subject"), "object").select("subject", "predicate", "object", "value", "valid_from", "source", "first_id", "last_id", "source_count")


@query("""WITH o AS (SELECT user_id, user_id // 3 AS mail, min(event_id) AS seq FROM events GROUP BY user_id),
    w AS (SELECT *, first_value(user_id) OVER (PARTITION BY mail ORDER BY seq) AS owner FROM o)
    SELECT concat('app:user/', CAST(owner AS STRING)) AS a, concat('app:user/', CAST(w.user_id AS STRING)) AS b, 'same_as' AS kind, 'proposed' AS status, ts AS valid_from FROM w JOIN events ON event_id = seq
    WHERE w.user_id <> owner""")
def ingest_links(spark, sf_dir):
    d = derived(spark, sf_dir)
    return _named(d, _named(d, d.links.select("a", "b", "kind", "status", "valid_from"), "a"), "b").select("a", "b", "kind", "status", "valid_from")


@query("""SELECT concat('app:user/', CAST(user_id AS STRING)) AS key, 'Person' AS kind, concat('user ', CAST(user_id AS STRING)) AS name FROM (SELECT DISTINCT user_id FROM events)
    UNION ALL SELECT concat('app:team/', CAST(t AS STRING)), '', CAST(t AS STRING) FROM (SELECT DISTINCT unnest(CASE WHEN event_id % 3 = 0 THEN [event_id % 7, (event_id + 1) % 7] ELSE [event_id % 7] END) AS t FROM events)""")
def ingest_records(spark, sf_dir):
    d = derived(spark, sf_dir)
    return _named(d, d.records.select(F.col("id").alias("key"), "kind", "name"), "key").select("key", "kind", "name")


@query(f"""WITH {_OBS} SELECT predicate, object, value, min(valid_from) AS valid_from, CAST(sum(n_support) AS BIGINT) AS source_count, count(*) AS merged FROM f
    WHERE valid_to IS NULL AND key = 'app:user/1' GROUP BY predicate, object, value""")
def answers_get(spark, sf_dir):
    d = derived(spark, sf_dir)
    found = answers.get(d, "app:user/1").withColumnRenamed("object_cluster", "object")
    return _named(d, found, "object").select("predicate", "object", "value", "valid_from", "source_count", "merged")


@query(f"""WITH {_OBS} SELECT 1 AS depth, key AS subject, predicate, object, min(valid_from) AS valid_from, CAST(sum(n_support) AS BIGINT) AS source_count FROM f
    WHERE valid_to IS NULL AND object = 'app:team/3' GROUP BY key, predicate, object""")
def answers_related(spark, sf_dir):
    d = derived(spark, sf_dir)
    found = answers.related(d, "app:team/3", "member_of", inward=True).withColumnsRenamed({"subject_cluster": "subject", "object_cluster": "object"})
    return _named(d, _named(d, found, "subject"), "object").select("depth", "subject", "predicate", "object", "valid_from", "source_count")


@query("""SELECT concat('app:user/', CAST(owner AS STRING)) AS a, concat('app:user/', CAST(user_id AS STRING)) AS b FROM (
      SELECT user_id, first_value(user_id) OVER (PARTITION BY user_id // 3 ORDER BY seq) AS owner FROM (SELECT user_id, min(event_id) AS seq FROM events GROUP BY user_id))
    WHERE user_id <> owner AND 1 IN (user_id, owner)""")
def answers_links_where(spark, sf_dir):
    d = derived(spark, sf_dir)
    found = answers.links_where(d.links, d.clusters, cluster=answers.cluster_of(d, "app:user/1"), kind="same_as", status="proposed")
    return _named(d, _named(d, found.select("a", "b"), "a"), "b")


# -- a matching run: nations as two directories know them, with half and a third of their customers as members --------------------

_PAIRS = """m AS (SELECT DISTINCT concat('a/', CAST(c_nationkey AS STRING)) AS c, c_custkey AS p FROM customer WHERE c_custkey % 2 = 0
      UNION ALL SELECT DISTINCT concat('b/', CAST(c_nationkey AS STRING)), c_custkey FROM customer WHERE c_custkey % 3 = 0),
    n AS (SELECT c, count(*) AS n FROM m GROUP BY c),
    k AS (SELECT x.c AS a, y.c AS b, count(*) AS k FROM m x JOIN m y ON x.p = y.p AND x.c < y.c GROUP BY x.c, y.c),
    t AS (SELECT concat('a/', CAST(n_nationkey AS STRING)) AS a, concat('b/', CAST(n_nationkey AS STRING)) AS b, n_nationkey AS nk FROM nation),
    s AS (SELECT t.a, t.b, nk, 0.6 + 0.3 * coalesce(k / CAST(x.n + y.n - k AS DOUBLE), 0) AS score FROM t LEFT JOIN k ON k.a = t.a AND k.b = t.b LEFT JOIN n x ON x.c = t.a LEFT JOIN n y ON y.c = t.b)"""


def _run(spark: SparkSession, sf_dir: str) -> match_run.Outcome:
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    number, both = F.col("n_nationkey").cast("string"), [("a", "title"), ("b", "lower")]
    entities = keys = members = None
    for side, style in both:
        name = F.initcap(F.lower("n_name")) if style == "title" else F.concat(F.lower("n_name"), F.lit("-"))
        own = nation.select(F.concat_ws("/", F.lit(side), number).alias("cluster_id"), F.lit("Team").alias("kind"), name.alias("name"), "n_nationkey")
        known = own.select("cluster_id", F.concat(F.lit(f"{side}:team/"), F.col("n_nationkey").cast("string")).alias("key"))
        of = customer.where(F.col("c_custkey") % (2 if side == "a" else 3) == 0)
        of = of.select(F.concat_ws("/", F.lit(side), F.col("c_nationkey").cast("string")).alias("cluster_id"), F.col("c_custkey").cast("string").alias("member"))
        entities, keys, members = (x if y is None else y.unionByName(x) for x, y in ((own.drop("n_nationkey"), entities), (known.where("cluster_id LIKE '%0'"), keys), (of, members)))
    day = lambda n: F.lit(f"2024-01-{n:02d} 00:00:00").cast("timestamp_ntz")
    seen = entities.select("cluster_id", F.when(~F.col("cluster_id").endswith("5"), day(9)).alias("last_seen"))
    barred = nation.where("n_nationkey % 10 = 3").select(F.concat(F.lit("l"), number).alias("id"), F.concat(F.lit("a/"), number).alias("a"), F.concat(F.lit("b/"), number).alias("b"))
    links = barred.withColumns({"kind": F.lit("distinct_from"), "status": F.lit("proposed"), "valid_from": day(1), "valid_to": F.lit(None).cast("timestamp_ntz")})
    old = nation.where("n_nationkey % 10 = 7").select(F.lit("").alias("id"), F.concat(F.lit("a/"), number).alias("a"), F.concat(F.lit("b/"), number).alias("b"))
    old = old.withColumns({"deposited_at": F.lit("2023-06-01 00:00:00").cast("timestamp_ntz"), "weight": F.lit(0.7), "against": F.lit(True), "features": F.lit("")})
    settings = match_run.Settings(rules=(("numbers", "a:team/{name}", "b:team/{name}"),), half_lives=(("Team", 60.0),))
    none = spark.createDataFrame([], "cluster_id string, email string")
    one = entities.select(F.col("cluster_id").alias("record_id"), "cluster_id")
    return match_run.run(spark, "2024-01-10 00:00:00", entities, keys, members, none, seen, links, one, old, settings, closure=kind_closure(kinds_frame(spark)))


@query("SELECT concat('a/', CAST(n_nationkey AS STRING)) AS a, concat('b/', CAST(n_nationkey AS STRING)) AS b, 'rule/numbers' AS rule FROM nation WHERE n_nationkey % 10 = 0")
def match_run_asserted(spark, sf_dir):
    """Pairs that a key rule asserts."""
    return _run(spark, sf_dir).asserted


@query(f"WITH {_PAIRS} SELECT a, b, round(score, 9) AS score, TIMESTAMP '2024-01-09 00:00:00' AS dated_at FROM s WHERE nk % 10 NOT IN (0, 3, 5)")
def match_run_deposits(spark, sf_dir):
    """Proposals of the run: not those that a rule asserts (0), that are held apart (3) or of which one side is gone (5)."""
    return _run(spark, sf_dir).deposits.select("a", "b", F.round("score", 9).alias("score"), "dated_at")


@query(f"""WITH {_PAIRS} SELECT concat(a, '/', b) AS id, round(score * pow(2.0, -1 / 60.0) - CASE WHEN nk % 10 = 7 THEN 0.7 * pow(2.0, -223 / 60.0) ELSE 0 END, 9) AS strength FROM s WHERE nk % 10 NOT IN (0, 3, 5)""")
def match_run_review(spark, sf_dir):
    """What awaits review, by evidence for and against that fades with the half-life of its kind."""
    return _run(spark, sf_dir).review.select("id", F.round("strength", 9).alias("strength"))


# -- screening: one observation for each event, of which eleven in twelve have one defect, by the event's number --------------------

#: remainder of the event's number -> (code, scope)
_DEFECTS = {
    1: ("malformed", "observation"), 2: ("not_declared", "observation"), 3: ("not_declared", "claim"), 4: ("invalid_value", "claim"), 5: ("invalid_interval", "claim"), 6: ("core_predicate", "claim"),
    7: ("type_mismatch", "claim"), 8: ("malformed", "observation"), 9: ("malformed", "observation"), 10: ("duplicate_claim", "observation"), 11: ("domain_mismatch", "claim"),
}


def _flawed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, source, type, time, observed_at, data), with the defect that ``_DEFECTS`` names."""
    n = F.col("event_id") % 12
    key = F.when(n == 1, F.concat(F.lit("repository "), "number")).otherwise(F.concat(F.lit("github:repository/"), "number"))
    entity = F.struct(F.when(n == 2, "Nothing").otherwise("Repository").alias("kind"), key.alias("key"), F.struct(F.when(n == 7, "high").alias("score"), F.lit("text").alias("description")).alias("attributes"))
    kind = F.when(n == 3, "likes").when(n == 6, "same_as").when(n == 11, "member_of").otherwise("approves_changes")
    relation = lambda ppm: F.struct(
        kind.alias("type"), F.concat(F.lit("github:team/"), (F.col("event_id") % 5).cast("string")).alias("to"), ppm.cast("int").alias("confidence_ppm"),
        F.when(n == 5, "2024-02-01T00:00:00Z").alias("valid_from"), F.when(n == 5, "2024-01-01T00:00:00Z").alias("valid_to"),
    )
    one, two = relation(F.when(n == 4, 0).otherwise(900_000)), relation(F.lit(5))
    data = F.to_json(F.struct(entity.alias("entity"), F.when(n == 10, F.array(one, two)).otherwise(F.array(one)).alias("relations")))
    return table(spark, sf_dir, "events").withColumn("number", F.col("event_id").cast("string")).select(
        F.concat(F.lit("o"), "number").alias("id"), F.lit("s").alias("source"), F.lit("t").alias("type"), F.when(n != 9, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("time"), F.col("ts").alias("observed_at"),
        F.when(n == 8, F.lit("{")).otherwise(data).alias("data"),
    )


def _screened(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    decoded, kinds = observations.decode(_flawed(spark, sf_dir)), kinds_frame(spark)
    p = predicates_frame(spark, [Declaration("x", {"Repository": "r"}, {"Repository": {"score": "FLOAT"}})])
    p = p.withColumn("domain", F.when(F.col("name") == "member_of", F.array(F.lit("Person")))).withColumn("range", F.lit(None).cast("array<string>"))
    return decoded, screening.screen(decoded, p, kinds, kind_closure(kinds), spark.createDataFrame([], "key string, kind string"))


_CODES = ", ".join(f"({n}, '{code}', '{scope}')" for n, (code, scope) in _DEFECTS.items())


@query(f"SELECT concat('o', CAST(event_id AS STRING)) AS obs_id, code, scope FROM events JOIN (VALUES {_CODES}) v(n, code, scope) ON event_id % 12 = n")
def screening_problems(spark, sf_dir):
    """Each observation's codes; a key that is no key is told of the entity and of the claims about it."""
    return _screened(spark, sf_dir)[1].select("obs_id", "code", "scope").distinct()


@query(f"SELECT concat('o', CAST(event_id AS STRING)) AS id FROM events LEFT JOIN (VALUES {_CODES}) v(n, code, scope) ON event_id % 12 = n WHERE scope IS DISTINCT FROM 'observation'")
def screening_kept(spark, sf_dir):
    return screening.kept(*_screened(spark, sf_dir)).select("id")
