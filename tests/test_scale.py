"""Plans that have to stay as they are on large tables."""

from pyspark.sql import functions as F

from checks import dumps as D
from fleetvitals.operators import catalog
from fleetvitals.sources import ingest

KEYS = "1 AS cluster_id, DATE '2024-01-31' AS snapshot_date, '10.0.0.1' AS node_ip, 'shop' AS table_schema"


def test_low_cardinality_holds_no_side_as_one_table(spark):
    """Sides that files make look small are not built into a hash table in each task's memory."""
    stats = spark.sql(f"SELECT {KEYS}, concat('t', id) AS table_name, 'ix_a' AS index_name, 'n_diff_pfx01' AS stat_name, id + 1 AS stat_value FROM range(3)")
    sizes = spark.sql(f"SELECT {KEYS}, concat('t', id) AS table_name, 5000 AS n_rows FROM range(2)")
    found = catalog.low_cardinality(stats, sizes)
    assert sorted((r.table_name, r.rnk) for r in found.collect()) == [("t0", 1), ("t1", 2)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_markers_are_sought_from_a_dash_on(spark):
    """Lines without a dash are passed at once; what precedes a marker on its line goes, a second marker in a line does not count."""
    text = "lead\n- x -" + D.marker(1, "one") + "a-b\n-----\nc\n" + D.marker(2, "two ----->>>---->>>").rstrip("\n")
    found = spark.createDataFrame([(text,), (D.marker(3, "three") + "|",), ("none",), ("",), (None,)], "content string").select(ingest.blocks(F.col("content")).alias("b")).collect()
    assert [[tuple(b) for b in r.b] if r.b is not None else None for r in found] == [
        [("one", "a-b\n-----\nc", True), ("two", "", False)], [("three", "|", True)], [], [], None
    ]
    pattern = spark.range(1).select(ingest.blocks(F.lit("").cast("string")).alias("b"))._jdf.queryExecution().analyzed().toString()
    assert "[^\\n-]*+(?=-)" in pattern
