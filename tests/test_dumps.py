"""A hand-written four-node cluster from text to score."""

import json
from datetime import date

import pytest

from fleetvitals.operators import documents, fleet, issues, workload
from fleetvitals.plans import assessment
from fleetvitals.sources import config, ingest, parse, tables
from tests import dumps

PRIMARY, REPLICA, BACKUP_NODE, DR = "172.16.7.2", "172.16.7.3", "172.16.7.4", "172.16.128.101"


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("dumps")
    dumps.write_cluster(root / "shop")
    return assessment.land_dumps(spark, str(root / "shop"), str(root / "landed"), "2026-05-01")


@pytest.fixture(scope="module")
def results(base):
    return assessment.assess_fleet(base)


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_roles_order_and_topology(results):
    assert rows(results["nodes"], "node_ip", "role") == {
        (PRIMARY, "primary"), (REPLICA, "slave"), (BACKUP_NODE, "slave"), (DR, "dr"),
    }
    assert results["nodes"].orderBy("node_order").first()["node_ip"] == PRIMARY
    assert rows(results["topology"], "label") == {("primary + 3 replicas (async)",)}


def test_host_facts(base):
    node = base["node_facts"].filter(f"node_ip = '{PRIMARY}'").first()
    assert node["os_release"] == "CentOS release 6.9 (Final)"
    assert node["binlog_bytes"] == 52 * 1024**3
    assert node["temp"]["size_bytes"] == 7168 * 1048576
    assert node["temp"]["source"] == "text"
    assert node["locks_collected"]
    assert node["variables"]["server_id"] == "2"
    assert node["variables"]["log_bin"] == "mysql-bin"
    assert node["variables"]["innodb_buffer_pool_size_in_mb"] == "40960"
    assert [(d["mount"], d["use_pct"]) for d in node["disks"]] == [("/", 91), ("/data", 45)]


def test_replication_fields_after_the_server_id_are_read(base):
    node = base["node_facts"].filter(f"node_ip = '{REPLICA}'").first()
    assert (node["is_replica"], node["lag_seconds"], node["last_io_error"]) == (True, 400, "")
    assert node["master_uuid"] == "5f0f-11"


def test_typed_table_reads_its_own_partition_only(base):
    plan = base["redundant_indexes"]._jdf.queryExecution().executedPlan().toString()
    assert "StartsWith(lower(section" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]


def test_banner_does_not_leak(base):
    texts = base["sections"].select("sections").collect()
    assert not any("module" in text for r in texts for text in r["sections"].asDict().values() if text)


def test_scan_reads_the_wanted_sections_only(base):
    plan = base["cron_lines"]._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "Crontab for mysql user" in schema and "hostname" not in schema


def test_row_with_a_pipe_goes_to_quarantine(base):
    assert rows(base["sql_by_latency"], "digest") == {("d1",)}
    bad = ingest.quarantine(ingest.boxed_rows(base["sections"]))
    assert bad.count() == 4


def test_lock_counters_and_redundant_indexes(base):
    assert (PRIMARY, "Innodb_row_lock_current_waits", "0") in rows(base["lock_counters"], "node_ip", "name", "value")
    assert rows(base["redundant_indexes"], "table_name", "redundant_index") == {("orders", "ix_a")}


def test_issues(results):
    issues = results["issues"]
    found = {(r["type"], r["node"]): r for r in issues.collect()}
    assert ("os_version_eol", "172.16.7.2 (primary)") in found
    assert found[("innodb_hll_high", "172.16.7.2 (primary)")]["priority"] == "P2"
    assert found[("dr_writable", "172.16.128.101 (dr)")]["priority"] == "P3"
    assert found[("backup_capability", "all nodes")]["priority"] == "P0"
    assert found[("slave_parallel_workers_zero", "3/4 nodes")]["priority"] == "P1"
    assert not any(t.startswith("compliance_fail") for t, _ in found)
    assert sorted(r["seq"] for r in found.values()) == list(range(1, issues.count() + 1))


def test_drift(results):
    judged = {r["name"]: r for r in results["parameter_drift"].collect()}
    assert judged["read_only"]["reason"] == "0 read-only primaries, 1 writable replicas"
    assert judged["server_id"]["ok"]
    matrix = rows(results["parameter_matrix"].filter("name = 'long_query_time'"), "node_ip", "value")
    assert (DR, "10") in matrix and (PRIMARY, "1") in matrix


def test_backup(results):
    backup = results["backup"].first()
    assert (backup["severity"], backup["has_artifact"], backup["age_days"]) == ("P0", True, 640)
    latest = results["latest_backup"].first()
    assert latest["node_ip"] == BACKUP_NODE and latest["path"].endswith("tbl_order_detail_20240729.sql")
    paths = {p for (p,) in rows(results["backup_paths"], "path")}
    assert {"/data/mysql/backup", "/opt/backup", "/opt/db_bak/bak_dir", "/data/backup"} <= paths


def test_security_tells_empty_from_missing(results):
    status = dict(rows(results["security_checks"], "check_id", "status"))
    assert status["strong_password_policy"] == "FAIL"
    assert status["innodb_encryption"] == "WARN"
    assert status["no_empty_password"] == "PASS"
    assert status["failed_login_baseline"] == "PASS"
    assert results["security_level"].first()["unknown"] == 0


def test_score_counts_the_backup_issue(results):
    scores = dict(rows(results["dimension_scores"], "dimension", "score"))
    # One P0 for the stale backup, two OS issues (P1, P2), one parameter the nodes disagree on (P2).
    assert scores["operations"] == 100 - 18 - 7 - 3 - 3


def test_document(spark, results, tmp_path):
    project = results["topology"].selectExpr("cluster_id", "snapshot_date", "'shop' AS value")
    parts = documents.document_parts(assessment.document_members(results, project))
    chunks = documents.cluster_documents(parts, slice_items=3).collect()
    doc: dict = {}
    for r in sorted(chunks, key=lambda r: r["chunk_no"]):
        value = json.loads(r["json"])
        assert r["n_items"] == (len(value) if isinstance(value, list) else int(value is not None))
        doc[r["member"]] = doc.get(r["member"], []) + value if isinstance(value, list) else value
    assert set(doc) == {name for name, _ in documents.MEMBERS}
    assert len(doc["nodes"]) == 4 and doc["schemaVersion"] == {"value": 3}
    # Slices of three hold every issue: nothing is lost to size.
    assert len(doc["issues"]) == results["issues"].count() > 3
    assert {n["node_ip"] for n in doc["nodes"]} == {PRIMARY, REPLICA, BACKUP_NODE, DR} and "mem_pct" in doc["nodes"][0]
    tables.write_documents(parts, str(tmp_path / "parts"))
    assert spark.read.text(str(tmp_path / "parts")).count() == parts.count()


def test_every_report_table_is_filled_from_dumps(base, results):
    tables_ = assessment.report_tables(base, results["nodes"])
    assert set(tables_) <= set(results) and len(tables_) == 31
    counts = {name: results[name].count() for name in tables_}
    assert all(counts[n] == 4 for n in ("node_inventory", "connection_usage", "performance_kpis", "buffer_pool", "slow_log_config", "engine_overview", "lineage"))
    inventory = {r["node_ip"]: r for r in results["node_inventory"].collect()}
    assert inventory[PRIMARY]["os_status"] == "eol"

    assert {r["band"] for r in results["disk_usage"].collect()} >= {"urgent", "ample"}
    assert rows(results["lock_summary"].filter(f"node_ip = '{PRIMARY}'"), "innodb_row_lock_current_waits") == {(0,)}
    assert rows(results["redundant_index_top"], "table_name", "redundant_index") == {("orders", "ix_a")}
    assert {f for (f,) in rows(results["lineage"], "file_name")} == {f for (f,) in rows(base["node_facts"], "file_name")}


def test_one_json_file_per_cluster(spark, results, tmp_path):
    project = results["topology"].selectExpr("cluster_id", "snapshot_date", "'shop' AS value")
    parts = documents.document_parts(assessment.document_members(results, project))
    for _ in range(2):  # writing again replaces
        tables.write_cluster_documents(documents.document_lines(parts), str(tmp_path))
    files = list(tmp_path.glob("cluster_id=*/snapshot_date=*/*.txt"))
    assert len(files) == 1
    doc = json.loads(files[0].read_text())
    assert list(doc) == [name for name, _ in documents.MEMBERS] and len(doc) == 17
    assert (doc["schemaVersion"], doc["project"], doc["overallAssessment"]) == (3, "shop", results["labels"].first()["label"])
    assert doc["cluster"]["topology"] == "primary + 3 replicas (async)" and doc["cluster"]["nodeCount"] == 4
    ordered = [r["node_ip"] for r in results["nodes"].orderBy("node_order").collect()]
    assert doc["cluster"]["ips"] == [n["ip"] for n in doc["nodes"]] == ordered
    assert [i["seq"] for i in doc["issues"]] == list(range(1, results["issues"].count() + 1))
    assert doc["healthScore"]["total"] == results["total_scores"].first()["total"]
    given = {(h, t) for h, texts in doc["recommendations"].items() for t in texts}
    assert given == rows(results["recommendations"], "horizon", "text")
    assert {c["code"] for c in doc["correlations"]} == {r[0] for r in rows(results["correlations"], "code")}
    assert {p["name"] for p in doc["paramJudgments"]} == {r[0] for r in rows(results["parameter_drift"], "name")}
    assert doc["backupAssessment"]["severity"] == "P0" and {c["check_id"] for c in doc["securityAssessment"]["checks"]} >= {"no_empty_password"}
    assert doc["hcConfig"]["disk.high_pct"] and doc["disabledRulesApplied"] is not None

    read = documents.read_documents(spark, str(tmp_path))
    assert documents.validate_documents(read).collect() == [] == documents.validate_parts(parts).collect()
    one_cluster = "cluster_id = 'shop'"
    assert read.where(one_cluster).count() == 1
    for member in ("project", "overallAssessment", "schemaVersion"):
        less = documents.validate_parts(parts.where(f"member <> '{member}'"))
        assert rows(less, "path", "message") == {(member, "missing")}


def test_a_document_longer_than_its_rows(spark, tmp_path):
    """Many items in one cluster, a cluster with a header only, one without nodes; texts with quotes and line ends."""
    issue = "struct(id AS seq, concat('say \\\"', id, '\\\"\\n') AS description, 'P1' AS priority)"
    issues_ = spark.range(5000).selectExpr("'big' AS cluster_id", "DATE'2026-05-01' AS snapshot_date", f"{issue} AS i").select("cluster_id", "snapshot_date", "i.*")
    head = spark.createDataFrame([("big",), ("bare",)], "cluster_id string").selectExpr("cluster_id", "DATE'2026-05-01' AS snapshot_date", "3 AS value")
    parts = documents.document_parts({"schemaVersion": head, "issues": issues_})
    tables.write_cluster_documents(documents.document_lines(parts), str(tmp_path))
    got = {f.parent.parent.name: json.loads(f.read_text()) for f in tmp_path.glob("cluster_id=*/snapshot_date=*/*.txt")}
    assert set(got) == {"cluster_id=big", "cluster_id=bare"}
    big, bare = got["cluster_id=big"], got["cluster_id=bare"]
    assert [i["seq"] for i in big["issues"]] == list(range(5000)) and big["issues"][7]["description"] == 'say "7"\n'
    assert bare["issues"] == [] and bare["nodes"] == [] and bare["cluster"] == {"name": None, "ips": []} and bare["healthScore"] is None
    assert bare["recommendations"] == {h: [] for h in documents.HORIZONS}
    found = documents.validate_documents(documents.read_documents(spark, str(tmp_path)))
    assert rows(found.where("cluster_id = 'bare'"), "path", "message") == {
        ("project", "missing"), ("inspectionDate", "missing"), ("reportDate", "missing"), ("cluster.topology", "missing"), ("cluster.nodeCount", "missing"),
        ("cluster.ips", "too short"), ("overallAssessment", "missing"), ("nodes", "too short"),
    }
    assert rows(documents.validate_parts(parts), *found.columns) == rows(found, *found.columns)


def test_broken_documents(spark):
    texts = {
        "none": None, "text": "{", "list": "[1]", "null": "null", "empty": "{}",
        "kinds": '{"schemaVersion":"3","project":5,"cluster":[],"issues":{},"nodes":[{"ip":1,"role":null},7],"healthScore":3,"collectorVersion":"x"}',
        "old": '{"schemaVersion":2,"collectorVersion":"3.1","issues":[{"priority":"P9"},{"description":"d"}],"nodes":[]}',
        "new": '{"schemaVersion":4}',
    }
    docs = spark.createDataFrame(list(texts.items()), "name string, json string")
    found = {}
    for r in documents.validate_documents(docs, ["name"]).collect():
        found.setdefault(r["name"], {})[(r["level"], r["path"], r["message"])] = r["n"]
    assert all(found[n] == {("ERROR", "$", "not an object"): 1} for n in ("none", "text", "list", "null"))
    required = {p for p, _, needed, _ in documents.DOCUMENT_FIELDS if needed}
    assert {p for _, p, m in found["empty"] if m == "missing"} == required | {"schemaVersion"} and len(found["empty"]) == len(required) + 1
    kinds = found["kinds"]
    assert kinds[("ERROR", "project", "not of kind string: number")] == 1 and kinds[("ERROR", "issues", "not of kind array: object")] == 1
    assert kinds[("ERROR", "healthScore", "not of kind object: number")] == 1 and kinds[("ERROR", "cluster.ips", "missing")] == 1
    assert kinds[("ERROR", "nodes.ip", "not of kind string: number")] == 1 and kinds[("ERROR", "nodes.ip", "missing")] == 1
    assert kinds[("ERROR", "nodes.role", "missing")] == 2 and kinds[("WARN", "collectorVersion", "not a version")] == 1
    old = found["old"]
    assert old[("WARN", "schemaVersion", "older than current")] == 1 and ("WARN", "collectorVersion", "not a version") not in old
    assert old[("WARN", "issues.priority", "not P0-P3")] == 1 == old[("ERROR", "issues.priority", "missing")] and old[("WARN", "issues.description", "missing")] == 1
    assert old[("ERROR", "nodes", "too short")] == 1 and found["new"][("WARN", "schemaVersion", "newer than supported")] == 1


def test_marts_are_written_per_snapshot(spark, results, tmp_path):
    tables.write_marts({"topology": results["topology"]}, str(tmp_path))
    tables.write_marts({"topology": results["topology"]}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "topology")).count() == 1
    assert tables.read_base_tables(spark, str(tmp_path), ["topology"])["topology"].count() == 1


def test_later_file_supersedes(spark, tmp_path):
    folder = tmp_path / "c1"
    folder.mkdir()
    for minute, host in (("1000", "old"), ("1130", "new")):
        name = f"XHealthCheck_10.0.0.1_20260430{minute}.txt"
        (folder / name).write_text(f"{dumps.marker(1, 'hostname')}\n{host}\n")
    (folder / "notes.txt").write_text("x")
    files = ingest.drop_superseded(spark, ingest.read_dumps(spark, str(folder)), str(folder), "2026-05-01")
    sections = ingest.with_sections(ingest.file_name_facts(files, "2026-05-01"), ["hostname"])
    assert rows(parse.node_facts(sections), "cluster_id", "hostname") == {("c1", "new")}


def test_no_dump_is_an_error(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        ingest.read_dumps(spark, str(tmp_path))


def test_full_slow_logs_are_split_by_entry(spark, tmp_path):
    entry = "# Time: 2026-01-0{d}\n# User@Host: a[a] @ [x]\n# Query_time: {d}.5  Lock_time: 0.1 Rows_sent: 1  Rows_examined: 9\nuse shop;\nSELECT {d};\n"
    # An older server: two more statements of other users under the last mark.
    more = "# User@Host: b[b] @ [y]\n# Query_time: 9.0  Lock_time: 0.1 Rows_sent: 1  Rows_examined: 9\nSELECT {d}0;\n"
    folder = tmp_path / "shop" / "10.0.0.7"
    folder.mkdir(parents=True)
    text = "server started with:\n" + "".join(entry.format(d=d) for d in (1, 2, 3)) + more.format(d=3) + more.format(d=4)
    (folder / "slow.log").write_text(text)
    entries = parse.read_slow_logs(spark, str(tmp_path), "2026-05-01")
    expected = {(f"2026-01-0{d}", "a[a] @ [x]", d + 0.5, "shop", f"SELECT {d};") for d in (1, 2, 3)}
    expected |= {("2026-01-03", "b[b] @ [y]", 9.0, None, f"SELECT {d}0;") for d in (3, 4)}
    assert rows(entries, "time", "user_host", "query_s", "db", "sql") == expected
    summary = workload.slow_log_summary(entries).first()
    assert (summary["cluster_id"], summary["node_ip"], summary["n_entries"], summary["max_query_s"]) == ("shop", "10.0.0.7", 5, 9.0)


def test_cluster_configuration_files(spark, tmp_path):
    for name, text in {
        "c1": '{"_doc": "x", "thresholds": {"_doc": "x", "disk": {"_doc": "y", "high_pct": 70}}, "priorities": {"_c": "x", "mem_high": "P0"}, "disabledRules": ["gtid_off", "_x"]}',
        "c2": "{broken",
    }.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "healthcheck.config.json").write_text(text)
    layer = config.read_cluster_layer(spark, str(tmp_path))
    assert rows(layer, "cluster_id", "key", "value") == {
        ("c1", "thresholds.disk.high_pct", "70"), ("c1", "priorities.mem_high", "P0"), ("c1", "disabledRules", "gtid_off"),
    }
    clusters = spark.createDataFrame([("c1",), ("c2",)], "cluster_id string")
    resolved = config.resolve_config(clusters, layer, {"thresholds.disk.high_pct": "75"})
    high = rows(resolved.filter("key = 'thresholds.disk.high_pct'"), "cluster_id", "value", "layer")
    assert high == {("c1", "75", "run"), ("c2", "75", "run")}
    assert config.load_override(str(tmp_path / "missing.json")) == {}
    assert config.load_override(str(tmp_path / "c2" / "healthcheck.config.json")) == {}


def test_landing_a_day_keeps_the_days_before(spark, tmp_path):
    for day, host in (("20260430", "monday"), ("20260501", "tuesday")):
        folder = tmp_path / day / "c1"
        folder.mkdir(parents=True)
        lines = [dumps.marker(1, "hostname"), host, dumps.marker(99, "Vendor check"), "all well", dumps.marker(2, "hostname of nobody")]
        (folder / f"XHealthCheck_10.0.0.1_{day}1000.txt").write_text("\n".join(lines) + "\n")
        base = assessment.land_dumps(spark, str(folder), str(tmp_path / "landed"), "2026-05-01")
    assert rows(base["node_facts"], "snapshot_date", "hostname") == {
        (date(2026, 4, 30), "monday"), (date(2026, 5, 1), "tuesday"),
    }
    # A section that no parser knows is landed too.
    other = base["other_sections"].collect()
    assert [(r["section"], r["text"].strip()) for r in other] == [("Vendor check", "all well")] * 2
    assert sum(p.is_dir() for p in (tmp_path / "landed" / "sections").iterdir()) == 2


def test_no_table_is_cut_at_parsing(spark, tmp_path):
    """More rows than any of the limits there once were."""
    folder = tmp_path / "c1"
    folder.mkdir()
    indexes = dumps.box(
        ["table_schema", "table_name", "redundant_index_name", "redundant_index_columns", "redundant_index_non_unique", "dominant_index_name", "dominant_index_columns", "dominant_index_non_unique", "subpart_exists", "sql_drop_index"],
        [["s", f"t{i}", "ix", "a", 1, "iy", "a,b", 1, 0, "x"] for i in range(250)],
    )
    logins = dumps.box(["IP", "HOST", "SUM_CONNECT_ERRORS"], [[f"10.0.0.{i}", "h", 500 if i == 29 else 1] for i in range(30)])
    trx = "".join(f"---TRANSACTION {i}, ACTIVE 1 sec\n{'x' * 300}\n" for i in range(25))
    text = "\n".join([
        dumps.marker(5, "Schema redundant indexes"), indexes, dumps.marker(6, "failed login attempts (host_cache)"), logins,
        dumps.marker(8, "Engine innodb status"), "LATEST DETECTED DEADLOCK\n------------------------\n" + "d" * 900 + "\n------------\nTRANSACTIONS\n------------\n" + trx + "--END", "",
    ])
    (folder / "XHealthCheck_10.0.0.1_202604301000.txt").write_text(text)
    base = assessment.land_dumps(spark, str(folder), str(tmp_path / "landed"), "2026-05-01")
    assert base["redundant_indexes"].count() == 250 and base["failed_logins"].count() == 30
    node = base["node_facts"].first()
    assert node["has_login_failures"] and len(node["latest_deadlock"]) == 900
    assert [len(t["detail"]) for t in node["active_transactions"]] == [300] * 25


def test_catalog_lists_are_whole(spark):
    from fleetvitals.operators import catalog

    key = "'c' AS cluster_id, DATE '2026-05-01' AS snapshot_date, '10.0.0.1' AS node_ip"
    tables = spark.range(300).selectExpr(
        key.split(", ")[0], *key.split(", ")[1:], "'s' AS table_schema", "concat('t', id) AS table_name", "'VIEW' AS table_type", "id AS auto_increment",
        "100L AS table_rows", "10000000L AS data_length", "0L AS index_length", "90000000L AS data_free",
    )
    columns = tables.selectExpr("*", "'c' AS column_name", "'enum' AS data_type", "'int' AS column_type", "'auto_increment' AS extra")
    usage = tables.selectExpr("*", "'ix' AS index_name", "1 AS non_unique", "0L AS count_star")
    sessions = tables.selectExpr("cluster_id", "snapshot_date", "node_ip", "table_name AS user_name", "'h' AS host")
    assert catalog.non_base_tables(tables).count() == catalog.fragmented_tables(tables).count() == 300
    assert catalog.nonstandard_types(columns).count() == catalog.unused_indexes(usage).count() == 300
    assert catalog.connected_users(sessions).count() == 300
    assert catalog.auto_increment_usage(tables, columns.withColumn("data_type", columns.column_type)).count() == 300
    assert catalog.non_base_tables(tables, k=7).count() == 7


def test_merged_text_names_the_merged_count(spark):
    schema = (
        "cluster_id string, snapshot_date date, node_ip string, role string, node_order string, type string, priority string, scope string, subject string, "
        "dimension string, n_objects bigint, description string, current_value string, recommended_value string, needs_confirmation boolean"
    )
    day = date(2026, 5, 1)
    raw = spark.createDataFrame(
        [("c", day, f"10.0.0.{i}", "slave", f"1|{i}", "no_pk_tables", "P2", "cluster", "", None, n, f"{n} tables", None, None, False) for i, n in ((1, 3), (2, 9), (3, 9))],
        schema,
    )
    nodes = raw.select("cluster_id", "snapshot_date", "node_ip")
    merged = issues.merge_issues(raw, nodes).first()
    assert (merged["n_objects"], merged["description"], merged["node_ip"], merged["node"]) == (9, "9 tables", "10.0.0.1", "all nodes")


def test_open_accounts_are_a_matter_of_the_cluster(results):
    found = [r for r in results["issues"].collect() if r["type"].startswith("wildcard_")]
    assert found and all(r["scope"] == "cluster" and r["n_nodes"] == 1 for r in found)
    assert results["wildcard_users"].count() >= len(found)


def test_nodes_without_an_address_keep_one_order(spark):
    rows_ = spark.createDataFrame([("c", "db-a", "slave"), ("c", "db-b", "slave"), ("c", "10.0.0.2", "slave"), ("c", "db-c", "primary")], "cluster_id string, node_ip string, role string")
    ordered = [r["node_ip"] for r in fleet.with_node_order(rows_).orderBy("node_order").collect()]
    assert ordered[0] == "db-c" and sorted(ordered[1:]) == ["10.0.0.2", "db-a", "db-b"]
    assert fleet.with_node_order(rows_).select("node_order").distinct().count() == 4


def test_assessment_from_tables_only(spark, base):
    """No dump: node facts and a server's own catalog tables."""
    keys = ["cluster_id", "snapshot_date", "node_ip"]
    facts = base["node_facts"]
    tables_ = facts.selectExpr(
        *keys, "'shop' AS table_schema", "'orders' AS table_name", "'BASE TABLE' AS table_type", "'InnoDB' AS engine", "'latin1_swedish_ci' AS table_collation",
        "100L AS table_rows", "10000000L AS data_length", "0L AS index_length", "200000000L AS data_free", "2000000000L AS auto_increment",
    )
    columns = facts.selectExpr(*keys, "'shop' AS table_schema", "'orders' AS table_name", "'id' AS column_name", "'int' AS data_type", "'int' AS column_type", "'auto_increment' AS extra")
    index_columns = facts.selectExpr(*keys, "'shop' AS table_schema", "'orders' AS table_name", "'ix' AS index_name", "1 AS seq", "'id' AS col", "1 AS non_unique")
    given = {
        "node_facts": facts, "cat_tables": tables_, "cat_columns": columns, "cat_index_columns": index_columns, "cat_users": base["users"],
        "cat_schemata": facts.selectExpr(*keys, "'shop' AS schema_name", "'utf8' AS charset", "'bin' AS schema_collation"), "sessions": base["sessions"],
    }
    found = assessment.assess_fleet(assessment.base_from_tables(given))
    types = {r["type"] for r in found["issues"].collect()}
    assert {"no_pk_tables", "non_utf8_tables", "auto_increment_exhausting", "heavy_frag_tables", "backup_capability"} <= types
    assert found["total_scores"].count() == 1 and found["slow_log_summary"].isEmpty() and found["schema_diff"].isEmpty()


def test_reports_and_declared_roles_reach_the_facts(spark, tmp_path):
    folder = tmp_path / "c1"
    folder.mkdir()
    (folder / "XHealthCheck_10.0.0.1_202604301000.txt").write_text(f"{dumps.marker(1, 'hostname')}\nh\n")
    cells = ["1", "./ibtmp1", *["9"] * 12, "4096", "1048576", "12582912", "0", "67108864", *["9"] * 12, "7", *["9"] * 6]
    reports = tmp_path / "reports" / "c1"
    reports.mkdir(parents=True)
    (reports / "10.0.0.1_2026-04-30.html").write_text("<table><tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr></table>")
    roles = spark.createDataFrame([("c1", "10.0.0.1", "DR node")], "cluster_id string, node_ip string, declared_role string")
    base = assessment.land_dumps(spark, str(folder), str(tmp_path / "landed"), "2026-05-01", reports_path=str(tmp_path / "reports"), declared_roles=roles)
    node = base["node_facts"].first()
    assert (node["temp"]["source"], node["temp"]["size_bytes"], node["declared_role"]) == ("html", 4096 * 1048576, "DR node")
