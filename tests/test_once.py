"""Columns that are made once give what columns made anew give."""

from pyspark.sql import functions as F

from fleetvitals.functions.once import made_once
from fleetvitals.operators import fleet, rules
from fleetvitals.sources.config import Config


def test_made_once_by_value(spark):
    calls = []

    @made_once
    def plus(name, n=1):
        calls.append((name, n))
        return (F.col(name) if isinstance(name, str) else name) + n

    assert plus("a", 2) is plus("a", 2) and calls == [("a", 2)]
    plus("a", 3)
    assert plus(F.col("a"), 1) is not plus(F.col("a"), 1) and len(calls) == 4  # a Column has no value to go by
    one, other = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(5, "x")], "a int, b string")
    assert (one.select(plus("a", 2)).first()[0], other.select(plus("a", 2)).first()[0]) == (3, 7)


def test_configurations_do_not_share_thresholds(spark):
    row = [("c", "2026-05-01", "10.0.0.1", 85.0)]
    nodes = fleet.conform(spark.createDataFrame(row, "cluster_id string, snapshot_date string, node_ip string, mem_pct double"))

    def fired(config):
        return rules.evaluate_rules(nodes, config, only=["mem_high"]).count()

    strict, lax = Config(run_layer={"thresholds.memory.high_pct": "80"}), Config(run_layer={"thresholds.memory.high_pct": "90"})
    assert (fired(strict), fired(lax), fired(strict), fired(Config(run_layer={"thresholds.memory.high_pct": "80", "disabledRules": "mem_high"}))) == (1, 0, 1, 0)
    layer = spark.createDataFrame([("c", "thresholds.memory.high_pct", "95")], "cluster_id string, key string, value string")
    other = spark.createDataFrame([("c", "thresholds.memory.high_pct", "70")], "cluster_id string, key string, value string")
    assert (fired(Config(layer)), fired(Config(other))) == (0, 1)
