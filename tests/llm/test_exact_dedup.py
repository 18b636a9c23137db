from pyspark.sql import functions as F

from fleetvitals.llm import exact_dedup
from tests.llm import brute


def expected(rows):
    groups = {}
    for i, _, _, text in rows:
        groups.setdefault(text or "", []).append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, brute.sha(text)) for i in ids]
    return sorted(map(str, out))


def result(df):
    return sorted(str((r.dump_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in df.collect())


def test_odd_rows(odd, nothing):
    from tests.llm.conftest import ODD

    assert result(exact_dedup.deduplicate(odd)) == expected(ODD)
    assert exact_dedup.deduplicate(nothing).count() == 0


def test_equal_digests_of_different_bytes_are_told_apart(spark):
    rows = [(i, None, None, f"text {i % 7}") for i in range(60)]
    dumps = spark.createDataFrame(rows, "dump_id long, cluster_id string, node_ip string, content string")
    weak = lambda content: F.length(content).cast("string")  # noqa: E731 every text here has the same digest
    assert result(exact_dedup.deduplicate(dumps, digest=weak)) == expected(rows)


def test_state_goes_on_between_runs(spark, tmp_path):
    """A second day's arrivals meet the first day's in the state, however long ago that was."""
    arrivals, state, changes = (str(tmp_path / n) for n in ("arrivals", "state", "changes"))
    schema = "digest string, dump_id long, locator string"
    for day in ([("a", 1, "f1"), ("b", 2, "f2")], [("a", 9, "f9"), ("c", 3, "f3")]):
        spark.createDataFrame(day, schema).write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(schema).parquet(arrivals)
        exact_dedup.run_stream(stream, state, changes)
    last = spark.read.parquet(changes).groupBy("digest").agg(F.max_by(F.struct("keep_id", "keep_locator", "n"), "batch_id").alias("s"))
    assert {r.digest: tuple(r.s) for r in last.collect()} == {"a": (9, "f9", 2), "b": (2, "f2", 1), "c": (3, "f3", 1)}
