"""Layered threshold configuration.

Two layers are global and tiny (built-in defaults, one run override); one layer
holds rows per cluster. Global layers become literals in the plan. The cluster
layer stays a DataFrame with at most one map per cluster.
"""

from __future__ import annotations

import json
import logging
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetvitals.functions import fixed_values as fv

log = logging.getLogger(__name__)

DISABLED_KEY = "disabledRules"
MAP_TYPE = "map<string,string>"


def flatten(config: dict[str, Any]) -> dict[str, str]:
    """Dotted keys of a configuration; arrays are leaves, keys that start with '_' are comments."""
    flat: dict[str, str] = {}

    def walk(prefix: str, node: dict[str, Any]) -> None:
        for key, value in node.items():
            if key.startswith("_"):
                continue
            path = f"{prefix}.{key}" if prefix else key
            if isinstance(value, dict):
                walk(path, value)
            elif isinstance(value, list):
                flat[path] = ",".join(v for v in value if isinstance(v, str) and not v.startswith("_"))
            else:
                flat[path] = str(value)

    walk("", config)
    return flat


def defaults() -> dict[str, str]:
    return flatten({"thresholds": fv.DEFAULT_THRESHOLDS, "priorities": {}, DISABLED_KEY: []})


def preset(name: str) -> dict[str, str]:
    """The strict or lenient preset as one more layer."""
    return flatten({"strict": fv.STRICT_PRESET, "lenient": fv.LENIENT_PRESET}[name])


def load_override(path: str | None) -> dict[str, str]:
    """A run override file; a missing or malformed file is ignored with a warning."""
    if path is None:
        return {}
    try:
        with open(path, encoding="utf-8") as f:
            return flatten(json.load(f))
    except (OSError, ValueError, AttributeError) as e:
        log.warning("configuration %s ignored: %s", path, e)
        return {}


def read_cluster_layer(spark: SparkSession, path: str, file_glob: str = "*.config.json") -> DataFrame:
    """Configuration files that lie next to the dumps: (cluster_id, key, value).

    A malformed file yields no rows.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=file_glob).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("cluster_id"),
        F.try_parse_json("value").alias("doc"),
    )
    thresholds = [
        F.struct(
            F.lit(f"thresholds.{key}").alias("key"),
            F.try_variant_get("doc", f"$.thresholds.{key}", "string").alias("value"),
        )
        for key in fv.DEFAULT_THRESHOLDS
    ]
    rules = F.transform(
        F.map_entries(F.try_variant_get("doc", "$.priorities", MAP_TYPE)),
        lambda e: F.struct(F.concat(F.lit("priorities."), e["key"]).alias("key"), e["value"].alias("value")),
    )
    rules = F.filter(rules, lambda e: ~e["key"].startswith("priorities._"))
    names = F.filter(
        F.try_variant_get("doc", f"$.{DISABLED_KEY}", "array<string>"), lambda x: ~x.startswith("_")
    )
    disabled = F.array(F.struct(F.lit(DISABLED_KEY).alias("key"), F.array_join(names, ",").alias("value")))
    none = F.filter(F.array(*thresholds[:1]), lambda e: F.lit(False))
    rows = F.concat(F.array(*thresholds), F.coalesce(rules, none), disabled)
    return (
        files.select("cluster_id", F.explode(F.filter(rows, lambda e: e["value"].isNotNull())).alias("e"))
        .select("cluster_id", "e.key", "e.value")
    )


def _literal_map(values: dict[str, str]) -> Column:
    if not values:
        return F.create_map().cast(MAP_TYPE)
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def cluster_maps(cluster_layer: DataFrame) -> DataFrame:
    """One map per cluster; its size is bounded by the number of known keys."""
    entries = F.collect_set(F.struct("key", "value"))
    return cluster_layer.groupBy("cluster_id").agg(F.map_from_entries(entries).alias("cluster_cfg"))


def resolve_config(
    clusters: DataFrame, cluster_layer: DataFrame | None = None, run_layer: dict[str, str] | None = None
) -> DataFrame:
    """Effective configuration: (cluster_id, key, value, layer); run beats cluster beats default."""
    base = clusters.select("cluster_id").distinct()
    if cluster_layer is None:
        base = base.withColumn("cluster_cfg", F.create_map().cast(MAP_TYPE))
    else:
        base = base.join(cluster_maps(cluster_layer), "cluster_id", "left").withColumn(
            "cluster_cfg", F.coalesce("cluster_cfg", F.create_map().cast(MAP_TYPE))
        )
    base = base.withColumn("default_cfg", _literal_map(defaults())).withColumn("run_cfg", _literal_map(run_layer or {}))
    keys = F.array_distinct(
        F.concat(F.map_keys("default_cfg"), F.map_keys("cluster_cfg"), F.map_keys("run_cfg"))
    )
    key = F.col("key")
    run, own, default = F.col("run_cfg")[key], F.col("cluster_cfg")[key], F.col("default_cfg")[key]
    return base.select("*", F.explode(keys).alias("key")).select(
        "cluster_id",
        "key",
        F.coalesce(run, own, default).alias("value"),
        F.when(run.isNotNull(), "run").when(own.isNotNull(), "cluster").otherwise("default").alias("layer"),
    )


def config_audit(resolved: DataFrame) -> DataFrame:
    """Where each cluster's configuration came from and which rules it disables."""
    return resolved.groupBy("cluster_id").agg(
        *[
            F.count_if(F.col("layer") == layer).alias(f"n_{layer}")
            for layer in ("default", "cluster", "run")
        ],
        F.max(F.when(F.col("key") == DISABLED_KEY, F.col("value"))).alias("disabled_rules"),
    )


class Config:
    """Effective settings as Columns over rows that carry cluster_cfg.

    Without a cluster layer every setting is a literal and nothing is joined.
    """

    def __init__(self, cluster_layer: DataFrame | None = None, run_layer: dict[str, str] | None = None):
        self.cluster_layer = cluster_layer
        self.run_layer = run_layer or {}
        self.default_layer = defaults()

    @property
    def columns_key(self) -> tuple:
        """Two configurations of equal key have the same Columns: cluster settings are looked up in the row."""
        return tuple(sorted(self.run_layer.items())), self.cluster_layer is not None

    def attach(self, df: DataFrame) -> DataFrame:
        """Adds the cluster's map. The map side has one row per configured cluster; Spark
        broadcasts it only while its measured size is under the broadcast threshold."""
        if self.cluster_layer is None:
            return df
        return df.join(cluster_maps(self.cluster_layer), "cluster_id", "left")

    def detach(self, df: DataFrame) -> DataFrame:
        return df if self.cluster_layer is None else df.drop("cluster_cfg")

    def value(self, key: str) -> Column:
        if key in self.run_layer:
            return F.lit(self.run_layer[key])
        default = F.lit(self.default_layer.get(key)).cast("string")
        if self.cluster_layer is None:
            return default
        return F.coalesce(F.col("cluster_cfg")[key], default)

    def threshold(self, key: str) -> Column:
        default = float(fv.DEFAULT_THRESHOLDS[key])
        if self.cluster_layer is None:
            return F.lit(float(self.run_layer.get(f"thresholds.{key}", default)))
        return F.coalesce(self.value(f"thresholds.{key}").try_cast("double"), F.lit(default))

    def priority(self, rule: Column, priority: Column) -> Column:
        run = {k.removeprefix("priorities."): v for k, v in self.run_layer.items() if k.startswith("priorities.")}
        options = [_literal_map(run)[rule]] if run else []
        if self.cluster_layer is not None:
            options.append(F.col("cluster_cfg")[F.concat(F.lit("priorities."), rule)])
        return F.coalesce(*options, priority)

    def is_enabled(self, rule: Column) -> Column:
        if self.cluster_layer is None or DISABLED_KEY in self.run_layer:
            disabled = self.run_layer.get(DISABLED_KEY, self.default_layer[DISABLED_KEY])
            names = [d for d in disabled.split(",") if d]
            return ~rule.isin(names) if names else F.lit(True)
        names = F.split(F.coalesce(F.col("cluster_cfg")[DISABLED_KEY], F.lit("")), ",")
        return ~F.array_contains(names, rule)


def apply_config(issues: DataFrame, config: Config) -> DataFrame:
    """Drops disabled rule types and overrides priorities."""
    rule = F.col("type")
    configured = config.attach(issues)
    kept = configured.filter(config.is_enabled(rule))
    return config.detach(kept.withColumn("priority", config.priority(rule, F.col("priority"))))
