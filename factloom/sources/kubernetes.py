"""Clusters of workloads: selector matching, environment references, dependencies, ports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OWNED_CONFIDENCE, ANNOTATION_CONFIDENCE, IMAGE_CONFIDENCE, DEPENDS_CONFIDENCE = 0.8, 0.9, 0.3, 0.9


def select_workloads(services: DataFrame, workloads: DataFrame) -> DataFrame:
    """(service, workload): the selector, if any, is part of the labels, in one namespace.

    One selector pair becomes an equi-join key; the other pairs are checked on its matches.
    """
    s = services.where(F.size("selector") > 0).withColumn("one", F.array_min(F.transform(F.map_entries("selector"), lambda e: F.concat_ws("=", e["key"], e["value"]))))
    w = workloads.withColumn("one", F.explode(F.transform(F.map_entries("labels"), lambda e: F.concat_ws("=", e["key"], e["value"]))))
    j = s.join(w, ["namespace", "one"])
    whole = F.size(F.map_filter("selector", lambda k, v: F.element_at(F.col("labels"), k).eqNullSafe(v))) == F.size("selector")
    return j.where(whole).select("service", "workload")


def references(env: DataFrame, value: str) -> DataFrame:
    """service, namespace, port, scheme of a URL or host[:port]; null where it names no service.

    A host of one label needs a scheme; two are service.namespace, three end in svc, five in svc.cluster.local.
    """
    v = F.trim(F.col(value))
    scheme = F.nullif(F.lower(F.regexp_extract(v, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lit(""))
    rest = F.regexp_replace(v, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    netloc = F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^.*@", "")
    port = F.regexp_extract(netloc, r":(\d{1,5})$", 1).try_cast("int")
    host = F.lower(F.regexp_replace(F.regexp_replace(netloc, r":\d*$", ""), r"\.$", ""))
    labels = F.split(host, r"\.")
    n = F.size(labels)
    good = F.forall(labels, lambda x: x.rlike("^[a-z]([a-z0-9-]*[a-z0-9])?$"))
    shape = ((n == 1) & scheme.isNotNull()) | (n == 2) | ((n == 3) & (F.get(labels, 2) == "svc")) | ((n == 5) & (F.concat_ws(".", F.slice(labels, 3, 3)) == "svc.cluster.local"))
    ok = good & shape
    return env.select("*", F.when(ok, labels[0]).alias("service"), F.when(ok & (n > 1), F.get(labels, 1)).alias("namespace"), F.when(ok, port).alias("port"), F.when(ok, scheme).alias("scheme"))


def injected(name: Column) -> Column:
    """Variables that the platform sets by itself."""
    return F.endswith(name, F.lit("_SERVICE_HOST")) | F.endswith(name, F.lit("_SERVICE_PORT")) | F.contains(name, F.lit("_PORT_"))


def resolve_port(port: Column, scheme: Column, ports: Column) -> tuple[Column, Column]:
    """(port, protocol): own port, else the scheme's default if exposed, else the first; the scheme, else what the port says, else tcp.

    ``ports``: array of (port, name, app_protocol).
    """
    usual = F.when(scheme == "http", 80).when(scheme == "https", 443).when(scheme.isin("postgres", "postgresql"), 5432).when(scheme == "redis", 6379).when(scheme == "mysql", 3306).when(scheme == "amqp", 5672)
    exposed = F.exists(ports, lambda p: p["port"] == usual)
    number = F.coalesce(port, F.when(exposed, usual), F.get(ports, 0)["port"])
    own = F.get(F.filter(ports, lambda p: p["port"] == number), 0)
    return number, F.coalesce(scheme, own["app_protocol"], F.nullif(own["name"], F.lit("")), F.lit("tcp"))


def dependencies(refs: DataFrame, services: DataFrame, targets: DataFrame) -> DataFrame:
    """One depends_on per workload and target, by the first reference in (container, env) order.

    ``refs(workload, own_namespace, container, pos, name, service, namespace, port, scheme)``,
    ``services(service, namespace, ports)``, ``targets(service, namespace, target)``.
    """
    r = refs.where(F.col("service").isNotNull() & ~injected(F.col("name"))).withColumn("namespace", F.coalesce("namespace", "own_namespace"))
    j = r.join(services, ["service", "namespace"]).join(targets, ["service", "namespace"]).where("workload <> target")
    port, protocol = resolve_port(F.col("port"), F.col("scheme"), F.col("ports"))
    j = j.withColumn("used_port", port).withColumn("protocol", protocol)
    w = Window.partitionBy("workload", "target").orderBy("container", "pos")
    first = j.withColumn("n", F.row_number().over(w)).where("n = 1")
    quals = F.to_json(F.struct(F.col("used_port").alias("port"), "protocol", "service", F.col("name").alias("via")))
    return first.select("workload", "target", F.lit(DEPENDS_CONFIDENCE).alias("confidence"), quals.alias("qualifiers"))


def repository_hint(annotation: Column, images: Column) -> tuple[Column, Column]:
    """(slug, confidence): the annotation, else the first ghcr.io image without tag or digest."""
    image = F.get(F.filter(images, lambda x: F.startswith(x, F.lit("ghcr.io/"))), 0)
    slug = F.regexp_replace(F.regexp_replace(F.substr(image, F.lit(9), F.length(image)), r"@.*$", ""), r":[^:/]*$", "")
    slug = F.concat_ws("/", F.slice(F.split(slug, "/"), 1, 2))
    own = F.nullif(F.trim(annotation), F.lit(""))
    return F.coalesce(own, slug), F.when(own.isNotNull(), ANNOTATION_CONFIDENCE).when(image.isNotNull(), IMAGE_CONFIDENCE)


def environments(namespaces: DataFrame, excluded: list[str]) -> DataFrame:
    return namespaces.where(~F.col("namespace").isin(excluded)).select(F.concat(F.lit("k8s:namespace/"), "namespace").alias("key"), F.lit("Environment").alias("kind"), F.col("namespace").alias("name"))


def service_index(services: DataFrame) -> DataFrame:
    """Services that select pods: with a selector, and not mere names for outside hosts."""
    return services.where((F.size(F.coalesce("selector", F.create_map().cast("map<string,string>"))) > 0) & (F.coalesce("type", F.lit("ClusterIP")) != "ExternalName"))


def workloads(w: DataFrame, team_label: str = "team") -> DataFrame:
    """Component claims: deployed_to its namespace, owned_by its team label, defined_in its repository.

    ``w(workload, namespace, labels, annotation, images)``; one row per claim with its confidence, and the
    predicates that the OUT snapshot covers.
    """
    slug, sure = repository_hint(F.col("annotation"), F.col("images"))
    team = F.nullif(F.try_element_at("labels", F.lit(team_label)), F.lit(""))
    claim = lambda p, obj, conf: F.struct(F.lit(p).alias("predicate"), obj.alias("object"), conf.cast("double").alias("confidence"))
    all_ = F.array(
        claim("deployed_to", F.concat(F.lit("k8s:namespace/"), "namespace"), F.lit(1.0)), claim("owned_by", F.concat(F.lit("k8s:team/"), team), F.lit(OWNED_CONFIDENCE)),
        claim("defined_in", F.concat(F.lit("github:name/"), F.lower(F.nullif(slug, F.lit("")))), sure),
    )
    kept = F.filter(all_, lambda c: c["object"].isNotNull())
    scope = F.array(*map(F.lit, ("deployed_to", "owned_by", "defined_in", "depends_on")))
    rows = w.select(F.concat_ws("/", F.lit("k8s:workload"), "namespace", "workload").alias("subject"), F.explode(kept).alias("c"), scope.alias("snapshot_out"))
    return rows.select("subject", "c.*", "snapshot_out")


def team_records(w: DataFrame, team_label: str = "team") -> DataFrame:
    """A bare Team record for each value of the label."""
    team = F.nullif(F.try_element_at("labels", F.lit(team_label)), F.lit(""))
    return w.select(team.alias("name")).where("name IS NOT NULL").distinct().select(F.concat(F.lit("k8s:team/"), "name").alias("key"), F.lit("Team").alias("kind"), "name")
