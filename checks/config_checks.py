"""CFG-*: layered configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from fleetvitals.functions import fixed_values as fv
from fleetvitals.sources import config as CF

RUN_LAYER = {"thresholds.memory.high_pct": "85", "priorities.gtid_off": "P3"}


def cluster_layer(v):
    """Strict for every fifth cluster, lenient for the next one."""
    rows = {
        name: F.array(*[F.struct(F.lit(k).alias("key"), F.lit(x).alias("value")) for k, x in CF.preset(name).items()])
        for name in ("strict", "lenient")
    }
    cluster = F.col("n_nationkey").cast("bigint")
    chosen = F.when(cluster % 5 == 0, rows["strict"]).when(cluster % 5 == 1, rows["lenient"])
    return v["nation"].select(cluster.alias("cluster_id"), F.explode(chosen).alias("e")).select("cluster_id", "e.*")


def layered_config(v) -> CF.Config:
    return CF.Config(cluster_layer(v), RUN_LAYER)


def LAYERED(key: str) -> str:
    """A threshold under the test layers, as SQL over cluster_id."""
    if f"thresholds.{key}" in RUN_LAYER:
        return f"{float(RUN_LAYER[f'thresholds.{key}'])}::DOUBLE"
    default = float(fv.DEFAULT_THRESHOLDS[key])
    strict = float(fv.STRICT_PRESET["thresholds"].get(key, default))
    lenient = float(fv.LENIENT_PRESET["thresholds"].get(key, default))
    return f"(CASE cluster_id % 5 WHEN 0 THEN {strict}::DOUBLE WHEN 1 THEN {lenient}::DOUBLE ELSE {default}::DOUBLE END)"


def layer_values(layer: int, config: dict[str, str], where: str) -> str:
    if not config:
        return ""
    values = ", ".join(f"('{k}', '{x}')" for k, x in config.items())
    return f"SELECT CAST(n_nationkey AS BIGINT) AS cluster_id, l.k, l.x, {layer} AS layer FROM nation, (VALUES {values}) l(k, x) WHERE {where}"


RESOLVED = "SELECT cluster_id, k AS key, x AS value, CASE layer WHEN 2 THEN 'run' WHEN 1 THEN 'cluster' ELSE 'default' END AS layer FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, k ORDER BY layer DESC) AS r FROM (" + " UNION ALL ".join([
    layer_values(0, CF.defaults(), "TRUE"),
    layer_values(1, CF.preset("strict"), "n_nationkey % 5 = 0"),
    layer_values(1, CF.preset("lenient"), "n_nationkey % 5 = 1"),
    layer_values(2, RUN_LAYER, "TRUE"),
]) + ")) WHERE r = 1"


def resolved(v):
    clusters = v["nation"].select(F.col("n_nationkey").cast("bigint").alias("cluster_id"))
    return CF.resolve_config(clusters, cluster_layer(v), RUN_LAYER)


@check("cfg_01_resolve_config", RESOLVED)
def _(v):
    return resolved(v)


@check("cfg_02_apply_config", """
SELECT cluster_id, type, CASE WHEN type = 'gtid_off' THEN 'P3' WHEN type = 'wildcard_medium' AND cluster_id % 5 = 1 THEN 'P3' ELSE 'P2' END AS priority, count(*) AS n
FROM (SELECT c_nationkey AS cluster_id, CASE c_custkey % 4 WHEN 0 THEN 'gtid_off' WHEN 1 THEN 'wildcard_medium' WHEN 2 THEN 'charset_not_utf8mb4' ELSE 'mem_high' END AS type FROM customer)
WHERE NOT (type = 'charset_not_utf8mb4' AND cluster_id % 5 = 1) GROUP BY ALL""")
def _(v):
    kinds = F.array(*[F.lit(t) for t in ("gtid_off", "wildcard_medium", "charset_not_utf8mb4", "mem_high")])
    issues = v["customer"].select(
        F.col("c_nationkey").cast("bigint").alias("cluster_id"),
        F.element_at(kinds, (F.col("c_custkey") % 4 + 1).cast("int")).alias("type"),
        F.lit("P2").alias("priority"),
    )
    applied = CF.apply_config(issues, layered_config(v))
    return applied.groupBy("cluster_id", "type", "priority").agg(F.count(F.lit(1)).alias("n"))


@check("cfg_03_presets", f"""
SELECT CAST(n_nationkey AS BIGINT) AS cluster_id, CASE n_nationkey % 5 WHEN 0 THEN 80 WHEN 1 THEN 95 ELSE 90 END AS disk_critical,
  n_nationkey % 5 <> 1 AS utf8_rule FROM nation""")
def _(v):
    config = layered_config(v)
    clusters = v["nation"].select(F.col("n_nationkey").cast("bigint").alias("cluster_id"))
    return config.attach(clusters).select(
        "cluster_id",
        config.threshold("disk.critical_pct").cast("int").alias("disk_critical"),
        config.is_enabled(F.lit("charset_not_utf8mb4")).alias("utf8_rule"),
    )


@check("snk_03_config_audit", f"""
SELECT cluster_id, count(*) FILTER (layer = 'default') AS n_default, count(*) FILTER (layer = 'cluster') AS n_cluster, count(*) FILTER (layer = 'run') AS n_run,
  max(CASE WHEN key = 'disabledRules' THEN value END) AS disabled_rules FROM ({RESOLVED}) GROUP BY cluster_id""")
def _(v):
    return CF.config_audit(resolved(v))
