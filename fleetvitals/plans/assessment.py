"""From dumps or base tables to every result table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from fleetvitals import CLUSTER_KEYS, KEYS
from fleetvitals.functions import scalars as S
from fleetvitals.functions.fixed_values import DEFAULT_THRESHOLDS
from fleetvitals.operators import assess, catalog, correlate, documents, drift, fleet, issues, marts, rules, workload
from fleetvitals.plans.lineage import cut_lineage
from fleetvitals.sources import ingest, parse
from fleetvitals.sources.config import Config


# Base tables that a source may lack; the analyses then see none of their rows.
OPTIONAL = {
    "backup_tools": "tool string, installed boolean, detail string",
    "backup_dirs": "path string, exists boolean, total_size string, n_files bigint",
    "backup_files": "dir string, path string, mtime timestamp, bytes bigint",
    "cron_lines": "source string, line string",
    "slow_log_entries": "time string, user_host string, query_s double, lock_s double, rows_sent bigint, rows_examined bigint, db string, sql string",
    "error_log_lines": "line_no int, line string, severity string",
    "top_tables": "table_schema string, table_name string, size_gb double, table_rows bigint, engine string",
    "db_sizes": "name string, size_gb double, is_total boolean",
    "large_columns": "table_schema string, table_name string, column_name string, data_type string",
    "partition_tables": "table_schema string, table_name string, n_partitions bigint",
    "routines": "routine_schema string, routine_name string, routine_type string, definer string",
    "object_counts": "db string, object_type string, cnt bigint",
    "unused_indexes": "table_schema string, table_name string, index_name string",
    "redundant_indexes": "table_schema string, table_name string, redundant_index string, dominant_index string",
    "lock_details": "waiting_trx_id string, blocking_trx_id string",
    "metadata_locks": "row_no int",
    "lock_counters": "name string, value string",
    "active_trx": "trx_id string, state string, detail string",
}


def _optional(base: dict[str, DataFrame], name: str) -> DataFrame:
    if name in base:
        return base[name]
    keys = base["node_facts"].select(*KEYS).limit(0)
    fields = [f.rsplit(" ", 1) for f in OPTIONAL[name].split(", ")]
    return keys.select(*KEYS, *[F.lit(None).cast(kind).alias(n) for n, kind in fields])


def _sized(top_tables: DataFrame) -> DataFrame:
    """Top tables with their bytes, which dumps give in GB only."""
    have = top_tables.columns
    return top_tables if "bytes" in have else top_tables.withColumn("bytes", F.round(F.col("size_gb") * S.GIB).cast("bigint"))


def report_tables(base: dict[str, DataFrame], nodes: DataFrame) -> dict[str, DataFrame]:
    """The tables of a report that need no rules: one per chapter, of every node or cluster."""
    top = _sized(_optional(base, "top_tables"))
    sizes = _optional(base, "db_sizes")
    sizes = sizes.withColumnRenamed("name", "table_schema") if "table_schema" not in sizes.columns else sizes
    no_pk = base["no_pk_tables"]
    no_pk = no_pk if "table_rows" in no_pk.columns else no_pk.withColumn("table_rows", F.lit(None).cast("bigint"))
    fragments = marts.significant_fragments(base["frag_tables"])
    reclaimable = marts.reclaimable(fragments, top)
    totals = nodes.select(*KEYS, F.round(F.col("db_total_gb") * S.GIB).cast("bigint").alias("bytes"))
    return {
        "node_inventory": marts.node_inventory(nodes),
        "disk_usage": marts.disk_usage(nodes),
        "connection_usage": marts.connection_usage(nodes),
        "performance_kpis": marts.performance_kpis(nodes),
        "buffer_pool": marts.buffer_pool(nodes),
        "slow_log_config": marts.slow_log_config(nodes),
        "capacity": marts.capacity(sizes),
        "top_tables": marts.tagged_top_tables(top),
        "significant_fragments": fragments,
        "reclaimable": reclaimable,
        "releasable_space": marts.releasable_space(reclaimable, totals),
        "no_pk_summary": marts.category_counts(no_pk),
        "no_pk_top": marts.no_pk_top(no_pk),
        "temp_tablespace_status": marts.temp_tablespace_status(nodes),
        "engine_overview": marts.engine_overview(nodes),
        "active_transactions": marts.active_transaction_list(_optional(base, "active_trx")),
        "lock_summary": marts.lock_summary(
            _optional(base, "lock_details"), _optional(base, "metadata_locks"), _optional(base, "lock_counters")
        ),
        "replication_status": marts.replication_status(nodes),
        "replication_health": marts.replication_health(nodes),
        "object_matrix": marts.object_matrix(_optional(base, "object_counts")),
        "unused_index_summary": marts.category_counts(_optional(base, "unused_indexes")),
        "redundant_index_summary": marts.category_counts(_optional(base, "redundant_indexes")),
        "unused_index_top": marts.index_top(_optional(base, "unused_indexes"), ["table_schema", "table_name", "index_name"]),
        "redundant_index_top": marts.index_top(
            _optional(base, "redundant_indexes"), ["table_schema", "table_name", "redundant_index", "dominant_index"], k=15
        ),
        "large_column_tables": marts.large_column_tables(_optional(base, "large_columns")),
        "auto_increment_bands": marts.auto_increment_bands(base["auto_increment"]),
        "partitions": _optional(base, "partition_tables"),
        "routines": _optional(base, "routines"),
        "long_sessions": marts.long_session_detail(base["sessions"]),
        "session_mix": marts.session_mix(base["sessions"]),
        "lineage": marts.lineage(nodes),
    }


def land_dumps(
    spark: SparkSession,
    path: str,
    out: str,
    run_date: str,
    project: str | None = None,
    reports_path: str | None = None,
    slow_logs_path: str | None = None,
    error_logs_path: str | None = None,
    declared_roles: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Reads the dumps once and lands all of them as Parquet, by snapshot.

    sections holds a field per known section, so each reader scans its own
    sections only; other_sections keeps the rest as collected; boxed rows are
    partitioned by section; node facts are one row per dump. Landing a snapshot
    again replaces that snapshot and leaves the others.

    reports_path: legacy HTML reports, whose temporary tablespace replaces the
    dumps'. slow_logs_path: full slow logs. error_logs_path: full error logs,
    which replace the tails that the dumps of their nodes hold. declared_roles: (cluster_id,
    node_ip, declared_role) from outside.
    """
    dumps = ingest.drop_superseded(spark, ingest.read_dumps(spark, path), path, run_date)
    landed, others, rows = _land_texts(ingest.file_name_facts(dumps, run_date, project), out, ["snapshot_date"])
    facts = parse.node_facts(landed)
    if reports_path is not None:
        reports = ingest.file_name_facts(ingest.read_html_reports(spark, reports_path), run_date, project)
        facts = parse.apply_html_temp(facts, parse.temp_tablespace_html(reports))
    if declared_roles is not None:
        roles = declared_roles.select("cluster_id", "node_ip", "declared_role")
        facts = facts.join(roles, ["cluster_id", "node_ip"], "left")
    facts = ingest.write_by_snapshot(facts, f"{out}/node_facts", ["snapshot_date"])
    return _base(spark, landed, others, facts, rows, run_date, slow_logs_path, error_logs_path)


def _texts(dumps: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Sections and other sections of dumps."""
    names = parse.ALL_SECTIONS
    blocked = ingest.with_blocks(dumps)
    sections = ingest.section_fields(ingest.with_sections(blocked, names), names)
    return sections.drop("blocks"), ingest.other_sections(blocked, names, keys)


def _land_texts(
    dumps: DataFrame, out: str, partition: list[str], load: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lands sections, other sections and boxed rows; of one load, if it is named."""
    keys = [*KEYS, *[c for c in partition if c not in KEYS]]
    sections, others = _texts(dumps, keys)
    landed = ingest.write_by_snapshot(sections, f"{out}/sections", partition)
    landed = landed if load is None else landed.filter(F.col("load_id") == load)
    others = ingest.write_by_snapshot(others, f"{out}/other_sections", partition)
    rows = ingest.write_by_snapshot(ingest.boxed_rows(landed, keys), f"{out}/boxed_rows", [*partition, "section"])
    return landed, others, rows


def land_new_dumps(spark: SparkSession, path: str, out: str, run_date: str, project: str | None = None) -> dict[str, DataFrame]:
    """Lands the dumps that have arrived under a path since the last run; returns the tables of all dumps landed so far.

    A manifest next to the landed tables names every file that a run has seen.
    Only files that it does not name are opened, and of several of one node and
    snapshot only the last by name; a dump that is older than what was landed is
    noted and left. Every run is a load of its own: landed tables are
    partitioned by load, nothing landed is rewritten, and readers see each
    node's last load. The manifest is written last, so a run that fails is
    repeated whole by the next one.
    """
    where = f"{out}/manifest"
    folder = spark._jvm.org.apache.hadoop.fs.Path(where)
    known = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)

    def manifest() -> DataFrame:
        return spark.read.schema(ingest.MANIFEST).parquet(where) if known else spark.createDataFrame([], ingest.MANIFEST)

    # The letter keeps readers from taking the partition's name for a number.
    load = f"L{(manifest().agg(F.count_distinct('load_id')).first()[0] if known else 0):08d}"
    fresh = ingest.unseen_dumps(ingest.list_dumps(spark, path, run_date), manifest())
    fresh = cut_lineage(fresh.withColumn("load_id", F.lit(load)).select(*[f.split(" ")[0] for f in ingest.MANIFEST.split(", ")]))
    # File names of new dumps only, as a listing has them in the driver anyway.
    paths = [r.file_path for r in fresh.filter("is_landed").select("file_path").toLocalIterator()]
    partition = ["load_id", "snapshot_date"]
    if paths:
        dumps = ingest.file_name_facts(ingest.read_listed(spark, paths), run_date, project).withColumn("load_id", F.lit(load))
        landed, _, _ = _land_texts(dumps, out, partition, load)
        facts = parse.node_facts(landed, [*KEYS, "load_id"])
        ingest.write_by_snapshot(facts, f"{out}/node_facts", partition)
    elif not known:
        raise FileNotFoundError(f"no dump file under {path}")
    if not fresh.isEmpty():
        fresh.coalesce(1).write.mode("append").parquet(where)
        known = True
    # The schemas follow from the code, not from files: a table may have no rows yet.
    none = spark.createDataFrame([], "file_path string, file_name string, content string")
    sections, others = _texts(ingest.file_name_facts(none, run_date).withColumn("load_id", F.lit(load)), [*KEYS, "load_id"])
    facts, rows = parse.node_facts(sections, [*KEYS, "load_id"]), ingest.boxed_rows(sections, [*KEYS, "load_id"])
    tables = [
        ingest.current(spark.read.schema(df.schema).parquet(f"{out}/{name}"), manifest())
        for name, df in (("sections", sections), ("other_sections", others), ("node_facts", facts), ("boxed_rows", rows))
    ]
    return _base(spark, *tables, run_date)


def _base(
    spark: SparkSession, landed: DataFrame, others: DataFrame, facts: DataFrame, rows: DataFrame, run_date: str,
    slow_logs_path: str | None = None, error_logs_path: str | None = None,
) -> dict[str, DataFrame]:
    """The tables that the analyses read, from what was landed."""
    names = parse.ALL_SECTIONS
    slow = parse.slow_log_entries(parse.section_texts(landed, "Slow query log tail"))
    if slow_logs_path is not None:
        slow = slow.unionByName(parse.read_slow_logs(spark, slow_logs_path, run_date).drop("file_name"))
    errors = parse.error_log_lines(parse.section_texts(landed, "Error log tail"))
    if error_logs_path is not None:
        full = parse.read_error_logs(spark, error_logs_path, run_date)
        # One row a node that has a full log.
        covered = full.select("cluster_id", "node_ip").distinct()
        errors = errors.join(covered, ["cluster_id", "node_ip"], "left_anti").unionByName(full.drop("file_name"))
    return {
        "sections": landed,
        "other_sections": others,
        "node_facts": facts,
        "backup_tools": parse.backup_tools(landed),
        "backup_dirs": parse.backup_dirs(landed),
        "backup_files": parse.backup_files(landed),
        "cron_lines": parse.cron_lines(landed),
        "slow_log_entries": slow,
        "error_log_lines": errors,
        "presence": ingest.section_presence(landed, names),
        "active_trx": parse.active_trx(landed),
        "metadata_locks": parse.raw_section_rows(rows, "Metadata locks"),
        **parse.typed_tables(rows),
    }


def base_from_tables(catalog_tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What the analyses need, computed from a server's own landed tables instead of dumps.

    catalog_tables: node_facts, cat_tables, cat_columns, cat_index_columns,
    cat_users, cat_schemata, sessions; and, where there are any, index_usage,
    lock_wait_rows, trx, status, backup_tools, backup_dirs, backup_files,
    cron_lines, slow_log_entries and error_log_lines.
    """
    given = dict(catalog_tables)
    base = {n: given[n] for n in OPTIONAL if n in given}
    base |= {
        "node_facts": given["node_facts"],
        "sessions": given["sessions"],
        "users": given["cat_users"],
        "databases": given["cat_schemata"].select(*KEYS, F.col("schema_name").alias("name"), "charset", F.col("schema_collation").alias("collation")),
        "frag_tables": catalog.fragmented_tables(given["cat_tables"]),
        "no_pk_tables": catalog.tables_without_pk(given["cat_tables"], given["cat_index_columns"]),
        "non_utf8_tables": catalog.non_utf8_tables(given["cat_tables"]),
        "auto_increment": catalog.auto_increment_usage(given["cat_tables"], given["cat_columns"]).filter("rate > 0.5"),
        "redundant_indexes": catalog.redundant_indexes(given["cat_index_columns"]),
        "top_tables": catalog.top_tables(given["cat_tables"]),
        "large_columns": catalog.large_columns(given["cat_columns"]),
        "db_sizes": catalog.schema_sizes(given["cat_tables"]),
    }
    if "index_usage" in given:
        base["unused_indexes"] = catalog.unused_indexes(given["index_usage"])
    if "lock_wait_rows" in given and "trx" in given:
        base["lock_details"] = workload.lock_waits(given["lock_wait_rows"], given["trx"])
    if "status" in given:
        base["lock_counters"] = workload.lock_counters(given["status"])
    return base


def node_table(base: dict[str, DataFrame], config: Config | None = None) -> DataFrame:
    """node_facts with roles and the sums of the child tables."""
    config = config or Config()
    frag = config.attach(base["frag_tables"])
    auto = config.attach(base["auto_increment"])
    children = [
        fleet.no_pk_facts(base["no_pk_tables"]),
        fleet.fragment_facts(frag, config.threshold("frag.rate"), config.threshold("frag.min_mb")),
        fleet.non_utf8_facts(base["non_utf8_tables"]),
        fleet.auto_increment_facts(auto, config.threshold("auto_increment.rate_p2")),
        fleet.session_facts(base["sessions"]),
        fleet.account_facts(base["users"]),
    ]
    nodes = fleet.add_child_facts(fleet.conform(base["node_facts"]), children)
    return fleet.resolve_roles(fleet.self_ref_replica(nodes))


def assess_fleet(base: dict[str, DataFrame], config: Config | None = None) -> dict[str, DataFrame]:
    """Every assessment of every cluster.

    Nodes and raw issues feed almost every result, so both are computed once
    and checkpointed; all results that follow are lazy.
    """
    config = config or Config()
    nodes = cut_lineage(node_table(base, config))
    topology = fleet.topology(nodes)
    clusters = topology.select(*CLUSTER_KEYS)

    tooling = assess.backup_tooling(_optional(base, "backup_tools"), nodes)
    backup_dirs, cron_lines = _optional(base, "backup_dirs"), _optional(base, "cron_lines")
    backup_files = _optional(base, "backup_files")
    tool = assess.has_tool(tooling)
    artifact = assess.has_artifact(backup_dirs)
    schedule = assess.has_schedule(cron_lines)
    latest = assess.latest_backup(backup_files, nodes)
    backup = assess.backup_severity(clusters, tool, artifact, schedule, latest)

    security = assess.security_facts(nodes)
    checks = assess.security_checks(security)

    raw = rules.evaluate_rules(nodes, config).unionByName(rules.parameter_issues(nodes, config))
    raw = cut_lineage(issues.promote_backup(raw, backup, config))
    # Scores, labels and recommendations need no numbers; only the issue list waits for them.
    merged = cut_lineage(issues.merge_double_trigger(issues.merge_issues(raw, nodes)))
    numbered = rules.with_advice(issues.number_issues(merged))
    advised = rules.with_advice(merged)
    drifting = drift.parameter_drift(nodes)

    evidence = backup.select(
        *CLUSTER_KEYS, "has_tool", "has_artifact", F.col("has_schedule").alias("has_backup_cron")
    )
    posture = security.select(*CLUSTER_KEYS, "has_encryption", "has_tls", "has_audit")
    scores = issues.dimension_scores(merged, clusters, evidence, posture)
    totals = issues.total_score(scores)
    labels = issues.overall_label(clusters, merged, totals)
    priorities = issues.priority_distribution(merged)
    return {
        "nodes": nodes,
        "topology": topology,
        "issues": numbered,
        "issue_nodes": issues.issue_nodes(raw),
        "dimension_scores": issues.score_levels(scores),
        "total_scores": totals,
        "labels": labels,
        "recommendations": issues.recommendations(advised, topology),
        "parameter_drift": drifting,
        "parameter_node_values": drift.parameter_node_values(nodes, drifting),
        "parameter_values": drift.parameter_values(nodes),
        "replication_matrix": drift.replication_matrix(nodes),
        "parameter_matrix": drift.parameter_matrix(nodes),
        "schema_diff": drift.schema_diff(base["databases"], nodes),
        "correlations": correlate.correlations(nodes),
        "backup_tooling": tooling,
        "backup_paths": assess.backup_paths(backup_dirs, cron_lines),
        "backup_dir_summary": assess.backup_dir_summary(backup_dirs, backup_files),
        "latest_backup": latest,
        "backup": backup,
        "security_checks": checks,
        "security_level": assess.security_level(checks),
        "frameworks": assess.framework_coverage(checks),
        "wildcard_users": assess.wildcard_users(base["users"]),
        "wildcard_groups": assess.wildcard_groups(base["users"]),
        "slow_log_summary": workload.slow_log_summary(_optional(base, "slow_log_entries")),
        "error_log_summary": workload.error_log_summary(_optional(base, "error_log_lines")),
        **report_tables(base, nodes),
        **({"section_presence": base["presence"]} if "presence" in base else {}),
        "key_facts": marts.key_facts(topology, totals, labels, priorities, backup),
        "action_plan": marts.action_plan(numbered),
        "replication_issues": marts.replication_issues(merged),
    }


def _grouped(rows: DataFrame, name: str) -> DataFrame:
    """A cluster's rows as one array; only for tables whose rows per cluster are a fixed list (checks, tools)."""
    columns = [c for c in rows.columns if c not in CLUSTER_KEYS]
    return rows.groupBy(*CLUSTER_KEYS).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def document_members(results: dict[str, DataFrame], project: DataFrame, config: Config | None = None, report_version: str = "1.0") -> dict[str, DataFrame]:
    """The members of each cluster's document. project: one row per cluster with its name."""
    config = config or Config()
    topology = results["topology"]
    date = F.col("snapshot_date").cast("string")

    def constant(value) -> DataFrame:
        return topology.select(*CLUSTER_KEYS, value.alias("value"))

    score = results["dimension_scores"].groupBy(*CLUSTER_KEYS).pivot("dimension", issues.DIMENSIONS).agg(F.max("score"))
    settings = config.attach(topology).select(
        *CLUSTER_KEYS,
        *[config.value(f"thresholds.{k}").alias(k) for k in DEFAULT_THRESHOLDS],
    )
    disabled = config.attach(topology).select(*CLUSTER_KEYS, config.value("disabledRules").alias("value"))
    return {
        "schemaVersion": constant(F.lit(documents.SCHEMA_VERSION)),
        "project": project,
        "reportVersion": constant(F.lit(report_version)),
        "inspectionDate": constant(date),
        "reportDate": constant(date),
        "cluster": topology.join(project, CLUSTER_KEYS, "left").select(
            *CLUSTER_KEYS, F.col("value").alias("name"), F.col("label").alias("topology"), F.col("n_nodes").alias("nodeCount"), "label", "n_nodes"
        ),
        documents.ADDRESSES: results["nodes"].select(*CLUSTER_KEYS, "node_ip", "node_order"),
        "healthScore": score.join(results["total_scores"], CLUSTER_KEYS, "left"),
        "overallAssessment": results["labels"].select(*CLUSTER_KEYS, "label"),
        "issues": results["issues"],
        "correlations": results["correlations"],
        "paramJudgments": results["parameter_drift"],
        "backupAssessment": results["backup"]
        .join(_grouped(results["backup_tooling"], "tools"), CLUSTER_KEYS, "left")
        .join(results["latest_backup"].withColumnsRenamed({c: f"latest_{c}" for c in ("node_ip", "path", "mtime", "bytes")}), CLUSTER_KEYS, "left"),
        "securityAssessment": results["security_level"].join(_grouped(results["security_checks"], "checks"), CLUSTER_KEYS, "left"),
        "nodes": results["nodes"].select(*KEYS, F.col("node_ip").alias("ip"), *[f.name for f in results["nodes"].schema if f.name not in KEYS and not isinstance(f.dataType, MapType)]),
        "recommendations": results["recommendations"],
        "hcConfig": settings,
        "disabledRulesApplied": disabled,
    }
