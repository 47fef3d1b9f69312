"""The driver's tables as facts, records and observations: plain projections that DuckDB reads alike.

``MODEL`` holds one SELECT for each model table; ``{name}`` stands for a driver table. The operators work
on the resulting DataFrames, the oracle on the same SELECTs as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

MODEL = {
    "fact": """
        SELECT concat('f', lpad(CAST(l_orderkey AS STRING), 10, '0'), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS id,
               concat('part/', CAST(l_partkey AS STRING)) AS subject_id,
               CASE WHEN l_returnflag = 'R' THEN 'approves_changes' ELSE 'owned_by' END AS predicate,
               concat('supp/', CAST(l_suppkey AS STRING)) AS object_id, CAST(NULL AS STRING) AS value,
               CASE WHEN l_tax >= 0.08 THEN 'proposed' ELSE 'asserted' END AS status, 1 - l_discount AS confidence,
               l_shipdate AS valid_from, CASE WHEN l_linestatus = 'F' THEN l_shipdate + INTERVAL '1' DAY * CAST(l_quantity AS INT) END AS valid_to,
               CASE WHEN l_linenumber % 2 = 0 THEN 'crm' ELSE 'erp' END AS source, CAST(l_quantity AS STRING) AS qualifiers
        FROM {lineitem}""",
    "support": """
        SELECT concat('f', lpad(CAST(l_orderkey AS STRING), 10, '0'), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS fact_id,
               concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(CAST(l_quantity AS INT) AS STRING), '@', CAST(i AS STRING)) AS observation_id,
               CASE WHEN (l_linenumber + i) % 2 = 0 THEN 'crm' ELSE 'erp' END AS source, l_shipdate + INTERVAL '1' DAY * CAST(i AS INT) AS observed_at
        FROM {lineitem} CROSS JOIN (VALUES (0), (1), (2)) AS v(i) WHERE i <= l_orderkey % 3""",
    "cluster": """
        SELECT concat('part/', CAST(p_partkey AS STRING)) AS record_id,
               concat('part/', CAST(CASE WHEN p_partkey % 10 = 1 THEN p_partkey - 1 ELSE p_partkey END AS STRING)) AS cluster_id FROM {part}
        UNION ALL SELECT concat('supp/', CAST(s_suppkey AS STRING)), concat('supp/', CAST(s_suppkey AS STRING)) FROM {supplier}""",
    "entity": """
        SELECT concat('part/', CAST(p_partkey AS STRING)) AS id, 'Component' AS kind, p_name AS name, CAST(p_partkey AS BIGINT) AS created_seq FROM {part}
        UNION ALL SELECT concat('supp/', CAST(s_suppkey AS STRING)), 'Team', s_name, CAST(1000000 + s_suppkey AS BIGINT) FROM {supplier}
        UNION ALL SELECT concat('cust/', CAST(c_custkey AS STRING)), 'Person', c_name, CAST(2000000 + c_custkey AS BIGINT) FROM {customer}
        UNION ALL SELECT concat('nation/', CAST(n_nationkey AS STRING)), 'org.Unit', n_name, CAST(3000000 + n_nationkey AS BIGINT) FROM {nation}""",
    "edge": """
        SELECT concat('e', CAST(p_partkey AS STRING), '-', CAST(i AS STRING)) AS id, concat('part/', CAST(p_partkey AS STRING)) AS src,
               concat('part/', CAST(CASE WHEN i = 0 THEN (p_partkey * 7 + 3) % n WHEN i = 1 THEN (p_partkey * p_partkey + 11) % n ELSE (p_partkey + n - 1) % n END AS STRING)) AS dst,
               CAST(p_size AS INT) AS size
        FROM {part} CROSS JOIN (VALUES (0), (1), (2)) AS v(i) CROSS JOIN (SELECT count(*) AS n FROM {part}) AS c""",
    "member": """
        SELECT concat('supp/', CAST(s_suppkey AS STRING)) AS team, concat('cust/', CAST(c_custkey AS STRING)) AS person, c_name AS name,
               CASE WHEN c_mktsegment = 'MACHINERY' THEN 'maintainer' WHEN c_mktsegment = 'FURNITURE' THEN NULL ELSE lower(c_mktsegment) END AS role, c_acctbal AS balance
        FROM {customer} JOIN {supplier} ON c_custkey % 97 = s_suppkey % 97""",
    "observation": """
        SELECT concat('app:user/', CAST(user_id AS STRING), '@', CAST(event_id AS STRING)) AS id, CASE WHEN event_id % 2 = 0 THEN 'web' ELSE 'api' END AS source,
               concat('app:user/', CAST(user_id AS STRING)) AS key, ts AS observed_at, event_id AS seq, event_type AS value, event_type = 'error' AS deleted,
               CAST(event_id % 7 AS INT) AS member
        FROM {events}""",
    "alias": """
        SELECT concat('app:user/', CAST(user_id AS STRING)) AS key, concat('user/', CAST(min(user_id - user_id % 2) AS STRING)) AS entity_id FROM {events} GROUP BY user_id""",
    "link": """
        SELECT concat('l', lpad(CAST(c_custkey AS STRING), 8, '0')) AS id, concat('cust/', CAST(c_custkey AS STRING)) AS a,
               concat('cust/', CAST(CASE WHEN c_custkey % 5 = 4 THEN c_custkey + 6 ELSE c_custkey + 1 END AS STRING)) AS b,
               CASE WHEN c_custkey % 11 = 0 THEN 'distinct_from' ELSE 'same_as' END AS kind, CASE WHEN c_acctbal < 0 OR c_custkey % 3 = 1 THEN 'proposed' ELSE 'asserted' END AS status,
               c_custkey AS nth
        FROM {customer}""",
    "proposal": """
        SELECT concat('p', lpad(CAST(event_id AS STRING), 9, '0')) AS id, concat('u', CAST(least(user_id, event_id % 37) AS STRING)) AS a,
               concat('v', CAST(greatest(user_id, event_id % 37) AS STRING)) AS b, 'same_as' AS kind,
               CASE WHEN event_type IN ('purchase', 'signup') THEN 'asserted' ELSE 'proposed' END AS status, ts AS at, value AS weight, event_type = 'error' AS against
        FROM {events}""",
    "log": """
        SELECT event_type AS part, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS off, CAST(event_id AS STRING) AS id, ts AS at,
               CAST(length(props) AS BIGINT) AS bytes, user_id % 10 = 0 AS retain
        FROM {events}""",
    "runtime": """
        SELECT concat('part/', CAST(p_partkey AS STRING)) AS id, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN 'Golang' WHEN p_partkey % 3 = 1 THEN ' go' ELSE 'python' END AS language,
               CASE WHEN p_size % 5 = 0 THEN concat('>=1.', CAST(p_size AS STRING)) WHEN p_size % 5 = 1 THEN concat('^1.', CAST(p_size AS STRING), ' || ^2.', CAST(p_partkey % 7 AS STRING))
                    WHEN p_size % 5 = 2 THEN 'lts/*' WHEN p_size % 5 = 3 THEN concat('v1.', CAST(p_size AS STRING), '.x') ELSE concat('1.', CAST(p_size AS STRING), '.0+b', CAST(p_size AS STRING)) END AS version
        FROM {part}""",
}
#: The two sides of ``member``, which meet where ``crew`` is equal: all teams of a crew have the same members.
SIDES = {
    "team": "SELECT concat('supp/', CAST(s_suppkey AS STRING)) AS team, s_suppkey % 97 AS crew FROM {supplier}",
    "person": """
        SELECT concat('cust/', CAST(c_custkey AS STRING)) AS person, c_name AS name,
               CASE WHEN c_mktsegment = 'MACHINERY' THEN 'maintainer' WHEN c_mktsegment = 'FURNITURE' THEN NULL ELSE lower(c_mktsegment) END AS role, c_acctbal AS balance,
               c_custkey % 97 AS crew
        FROM {customer}""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    body = MODEL[name] if name in MODEL else SIDES[name]
    return spark.sql(body, **{t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in body})


def oracle(body: str) -> str:
    """``body`` for DuckDB, with the model tables that it names as common table expressions."""
    names = [n for n in MODEL if re.search(rf"\b{n}\b", body)]
    quoted = lambda sql: re.sub(r"(?<![\w'\"])at(?![\w'\"])", '"at"', sql)  # noqa: E731  a reserved word there
    body = quoted(body)
    ctes = ",\n".join(f"{n} AS ({quoted(re.sub(r'[{}]', '', MODEL[n]))})" for n in names)
    body = body.strip()
    if not names:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[14:].strip()}"
    return f"WITH {ctes},\n{body[4:].strip()}" if body.upper().startswith("WITH") else f"WITH {ctes}\n{body}"
