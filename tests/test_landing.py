"""Landing by measured size, and where intermediate tables may lie."""

import glob

import pytest
from pyspark.sql import functions as F

from fleetvitals.operators import workload
from fleetvitals.plans import assessment
from fleetvitals.plans.lineage import shared_folder
from fleetvitals.sources import ingest, parse, tables
from tests import dumps


@pytest.fixture
def small_files(spark):
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    yield 256 << 10
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)


def rows(spark, n, day):
    noise = F.concat_ws("", *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"-{i}")), 512) for i in range(8)])
    return spark.range(0, n, 1, 12).select(
        F.lit("one").alias("cluster_id"), F.lit(day).cast("date").alias("snapshot_date"), F.lit("10.0.0.1").alias("node_ip"), noise.alias("text"), "id"
    )


def test_one_hot_snapshot_is_written_by_many_tasks(spark, tmp_path, small_files):
    """One node of one snapshot, far more than eight files' worth."""
    hot, cold = rows(spark, 12_000, "2026-05-01"), rows(spark, 5, "2026-05-02")
    landed = ingest.write_by_snapshot(hot.unionByName(cold), str(tmp_path), ["snapshot_date"])
    assert landed.count() == 12_005 and landed.select("id").where("snapshot_date = '2026-05-01'").distinct().count() == 12_000
    files = {d: glob.glob(f"{tmp_path}/snapshot_date={d}/*.parquet") for d in ("2026-05-01", "2026-05-02")}
    assert len(files["2026-05-01"]) > 8 and len(files["2026-05-02"]) <= 2


def test_small_snapshots_leave_few_files(spark, tmp_path):
    days = [f"2026-05-{d:02d}" for d in range(1, 6)]
    given = rows(spark, 40, days[0])
    for day in days[1:]:
        given = given.unionByName(rows(spark, 40, day))
    ingest.write_by_snapshot(given, str(tmp_path), ["snapshot_date"])
    assert all(len(glob.glob(f"{tmp_path}/snapshot_date={d}/*.parquet")) == 1 for d in days)


class _Session:
    """A session on a cluster, as far as the shared folder asks."""

    def __init__(self, **conf):
        self.conf = {k.replace("_", "."): v for k, v in conf.items()}
        self.sparkContext = type("Context", (), {"master": "spark://driver:7077"})


def test_shared_folder_is_never_a_machine_s_own():
    assert shared_folder(_Session(spark_checkpoint_dir="hdfs://x/y/")) == "hdfs://x/y"
    assert shared_folder(_Session(spark_sql_warehouse_dir="s3a://bucket/w")) == "s3a://bucket/w/_checkpoints"
    for local in ("/tmp/warehouse", "file:/tmp/warehouse", "spark-warehouse"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_folder(_Session(spark_sql_warehouse_dir=local))


@pytest.mark.parametrize("split", ["128m", "10k", "777"])
def test_error_logs_have_the_same_numbers_in_any_splits(spark, tmp_path, split):
    logs = {("shop", "10.0.0.1"): 900, ("shop", "10.0.0.2"): 1, ("pay", "10.0.0.3"): 350}
    wanted = {}
    for (cluster, ip), n in logs.items():
        folder = tmp_path / cluster / ip
        folder.mkdir(parents=True)
        texts = [f"2026-05-01 {i} " + ("[ERROR] x" if i % 7 == 0 else "" if i % 11 == 0 else "[Note] " + "y" * (i % 50)) for i in range(n)]
        (folder / "error.log").write_text(("\r\n" if cluster == "pay" else "\n").join(texts) + "\n")
        wanted |= {(cluster, ip, i): t for i, t in enumerate(texts)}
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        lines = parse.read_error_logs(spark, str(tmp_path), "2026-05-01")
        assert lines.rdd.getNumPartitions() > 3 or split == "128m"
        assert {(r.cluster_id, r.node_ip, r.line_no): r.line for r in lines.collect()} == wanted
        last = workload.error_log_tail(lines).where("cluster_id = 'shop' and node_ip = '10.0.0.1' and severity = 'error'").collect()
        assert sorted(r.line_no for r in last) == [i for i in range(900) if i % 7 == 0][-20:]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_only_new_dumps_are_read(spark, tmp_path, monkeypatch):
    """Three runs: four dumps, then a later one of a known node, then an older one and a new snapshot; the last by name wins throughout."""
    opened, read = [], ingest.read_listed
    monkeypatch.setattr(ingest, "read_listed", lambda spark, paths: opened.append(sorted(p.rsplit("/", 1)[1] for p in paths)) or read(spark, paths))
    source, out = tmp_path / "dumps" / "shop", str(tmp_path / "landed")
    dumps.write_cluster(source)

    def run():
        base = assessment.land_new_dumps(spark, str(tmp_path / "dumps"), out, "2026-05-01")
        return base, {(r.node_ip, str(r.snapshot_date)): r.hostname for r in base["node_facts"].collect()}

    def put(ip, stamp, host):
        (source / f"MyHealthCheck_{ip}_{stamp}.txt").write_text(f"{dumps.marker(1, 'hostname')}\n{host}\n{dumps.marker(5, 'BLOB info')}\n| a | b | c | d |\n| x | {host} | c | text |\n")

    first_base, first = run()
    assert len(opened[0]) == 4 and len(first) == 4 and first_base["redundant_indexes"].count() == 4
    day = next(iter(first))[1]
    stamp = day.replace("-", "")
    put("172.16.7.3", f"{stamp}2359", "later")
    base, second = run()
    assert opened[1] == [f"MyHealthCheck_172.16.7.3_{stamp}2359.txt"]
    assert second == first | {("172.16.7.3", day): "later"}
    assert base["large_columns"].where("node_ip = '172.16.7.3'").select("table_name").collect() == [("later",)]
    assert base["redundant_indexes"].count() == 3 and base["sections"].count() == 4
    put("172.16.7.3", f"{stamp}0001", "older")
    put("172.16.7.3", "202701010101", "next year")
    _, third = run()
    assert opened[2] == ["MyHealthCheck_172.16.7.3_202701010101.txt"]
    assert third == second | {("172.16.7.3", "2027-01-01"): "next year"}
    # Nothing new: no dump is opened, and the tables stay.
    _, again = run()
    assert len(opened) == 3 and again == third
    assert {k: v for k, v in assessment.assess_fleet(base).items() if k == "topology"}["topology"].count() == 1


def test_no_dump_at_all(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        assessment.land_new_dumps(spark, str(tmp_path), str(tmp_path / "out"), "2026-05-01")


@pytest.mark.parametrize("fmt", ["csv", "tsv", "json"])
def test_malformed_records_go_to_the_quarantine(spark, tmp_path, fmt):
    sep = {"csv": ",", "tsv": "\t"}.get(fmt)
    good = [(1, 1.5, "a"), (2, None, "b c"), (3, 2.0, None)]
    if sep:
        lines = ["id" + sep + "size" + sep + "name", *(sep.join("" if x is None else str(x) for x in r) for r in good)]
        bad = [sep.join(("x", "1", "y")), sep.join(("4", "much", "y")), sep.join(("5", "1", "y", "z")), "6"]
    else:
        lines = ['{"id":1,"size":1.5,"name":"a"}', '{"id":2,"name":"b c"}', '{"id":3,"size":2.0,"name":null,"more":1}']
        bad = ['{"id":"x"}', '{"id":4,', "7"]
    (tmp_path / "rows.txt").write_text("\n".join([*lines, "", *bad]) + "\n")
    rows, quarantine = tables.read_with_quarantine(spark, str(tmp_path), fmt, "id bigint, size double, name string", header=bool(sep))
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(good, key=str)
    assert rows.select("id").count() == 3 and rows.count() == 3  # whichever columns are read
    assert sorted(r.record for r in quarantine.collect()) == sorted(bad)
    assert {r.file_path.rsplit("/", 1)[1] for r in quarantine.collect()} == {"rows.txt"}


def test_column_names_of_server_versions(spark):
    old = spark.createDataFrame([("c", "1", "2")], "cluster_id string, requesting_trx_id string, blocking_trx_id string")
    new = spark.createDataFrame([("c", "1", "2", "x")], "cluster_id string, REQUESTING_ENGINE_TRANSACTION_ID string, BLOCKING_ENGINE_TRANSACTION_ID string, ENGINE string")
    for df in (old, new):
        found = tables.conform_to_server(df, "lock_wait_rows", ["cluster_id"])
        assert found.columns == ["cluster_id", "waiting_trx_id", "blocking_trx_id"] and tuple(found.first()) == ("c", "1", "2")
    bare = tables.conform_to_server(old, "lock_rows", ["cluster_id"]).first()
    assert bare["trx_id"] is None and bare["lock_mode"] is None
