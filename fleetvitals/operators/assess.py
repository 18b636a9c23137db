"""Backup capability and security posture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetvitals import CLUSTER_KEYS, KEYS
from fleetvitals.functions import fixed_values as fv
from fleetvitals.functions import scalars as S


def backup_tooling(
    backup_tools: DataFrame, nodes: DataFrame, keys: list[str] = KEYS, cluster_keys: list[str] = CLUSTER_KEYS
) -> DataFrame:
    """The first report of each tool in node order."""
    ordered = backup_tools.join(nodes.select(*keys, "node_order"), keys)
    return (
        ordered.groupBy(*cluster_keys, "tool")
        .agg(F.min_by(F.struct("installed", "detail"), "node_order").alias("f"))
        .select(*cluster_keys, "tool", "f.installed", "f.detail")
    )


def has_tool(tooling: DataFrame, cluster_keys: list[str] = CLUSTER_KEYS) -> DataFrame:
    usable = F.col("installed") & F.col("tool").rlike(fv.BACKUP_TOOL)
    return tooling.groupBy(*cluster_keys).agg(F.bool_or(usable).alias("has_tool"))


def latest_backup(
    backup_files: DataFrame, nodes: DataFrame, keys: list[str] = KEYS, cluster_keys: list[str] = CLUSTER_KEYS
) -> DataFrame:
    """The newest artefact; ties go to the first node in node order, then to the smallest path.

    Files of nodes that are not in the node table come last.
    """
    ordered = backup_files.join(nodes.select(*keys, "node_order"), keys, "left")
    ordered = ordered.withColumn("node_order", F.coalesce("node_order", F.concat(F.lit("~|"), "node_ip")))
    per_time = ordered.groupBy(*cluster_keys, "mtime").agg(F.min(F.struct("node_order", "path", "bytes", "node_ip")).alias("f"))
    return (
        per_time.groupBy(*cluster_keys)
        .agg(F.max_by(F.struct("f", "mtime"), "mtime").alias("m"))
        .select(*cluster_keys, "m.f.node_ip", "m.f.path", "m.mtime", "m.f.bytes")
    )


def has_artifact(backup_dirs: DataFrame, cluster_keys: list[str] = CLUSTER_KEYS) -> DataFrame:
    return backup_dirs.groupBy(*cluster_keys).agg(F.bool_or(F.col("n_files") > 0).alias("has_artifact"))


def has_schedule(cron_lines: DataFrame, cluster_keys: list[str] = CLUSTER_KEYS) -> DataFrame:
    return cron_lines.groupBy(*cluster_keys).agg(F.bool_or(F.col("line").rlike(fv.BACKUP_CRON)).alias("has_schedule"))


def backup_paths(
    backup_dirs: DataFrame, cron_lines: DataFrame, cluster_keys: list[str] = CLUSTER_KEYS
) -> DataFrame:
    """Where backups may be: scanned directories and paths named in schedules."""
    scanned = backup_dirs.select(*cluster_keys, S.clean_path("path").alias("path"))
    named = cron_lines.select(*cluster_keys, F.explode(S.paths_in_text("line")).alias("path"))
    return scanned.unionByName(named).filter(F.col("path").rlike(fv.BACKUP_PATH)).distinct()


def backup_severity(
    clusters: DataFrame,
    tool: DataFrame,
    artifact: DataFrame,
    schedule: DataFrame,
    latest: DataFrame,
    cluster_keys: list[str] = CLUSTER_KEYS,
) -> DataFrame:
    """Severity ladder per cluster; age counts from the snapshot date, not from today."""
    joined = (
        clusters.select(*cluster_keys)
        .join(tool, cluster_keys, "left")
        .join(artifact, cluster_keys, "left")
        .join(schedule, cluster_keys, "left")
        .join(latest.select(*cluster_keys, "mtime"), cluster_keys, "left")
    )
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("has_tool", "has_artifact", "has_schedule")}
    age = F.datediff("snapshot_date", "mtime").cast("bigint")
    joined = joined.withColumns({**flags, "age_days": age})
    tool_c, art, sched, days = (F.col(c) for c in ("has_tool", "has_artifact", "has_schedule", "age_days"))
    ladder: list[tuple[Column, str, Column]] = [
        (~tool_c, "P0", F.lit("no backup tool found")),
        (~art & sched, "P2", F.lit("scheduled, but no artefact in the scanned directories")),
        (~art, "P1", F.lit("a tool but no artefact")),
        (~sched, "P2", F.lit("artefacts but no schedule")),
        (days <= 1, "OK", F.format_string("latest backup is %d days old", days)),
        (days <= 7, "P2", F.format_string("latest backup is %d days old, too rare", days)),
    ]
    severity = S.first_case([(c, F.lit(p)) for c, p, _ in ladder], F.lit("P0"))
    text = S.first_case([(c, t) for c, _, t in ladder], F.format_string("latest backup is %d days old, data at risk", days))
    return joined.withColumns({"severity": severity, "assessment": text}).drop("mtime")


def backup_dir_summary(backup_dirs: DataFrame, backup_files: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """File count, latest file (of one time, that of the last path) and its restore estimate per scanned directory."""
    files = backup_files.groupBy(*keys, "dir").agg(
        F.count(F.lit(1)).alias("n_found"),
        F.max("mtime").alias("latest"),
        F.max_by("bytes", F.struct("mtime", "path")).alias("latest_bytes"),
        F.sum("bytes").cast("bigint").alias("total_bytes"),
    )
    return (
        backup_dirs.withColumnRenamed("path", "dir")
        .join(files, [*keys, "dir"], "left")
        .select(
            *keys,
            F.col("dir").alias("path"),
            "exists",
            "total_size",
            F.coalesce("n_found", F.lit(0)).cast("bigint").alias("n_files"),
            "latest",
            "total_bytes",
            F.ceil(F.col("latest_bytes") / float(fv.RESTORE_BYTES_PER_SECOND)).alias("restore_s"),
        )
    )


def security_facts(nodes: DataFrame, cluster_keys: list[str] = CLUSTER_KEYS) -> DataFrame:
    """Evidence per cluster. Presence and value are kept apart."""
    tls = F.col("tls_config")
    first = F.struct("has_password_policy", "tls_config")

    def present(column: Column) -> Column:
        return F.bool_or(column.isNotNull())

    def some(name: str) -> Column:
        return F.coalesce(F.bool_or(F.col(name)), F.lit(False))

    return nodes.groupBy(*cluster_keys).agg(
        # node_order puts the primary first, so the minimum is the primary or else the first node.
        F.min_by(first, "node_order").alias("lead"),
        present(F.col("has_password_policy")).alias("saw_policy"),
        F.bool_or(F.coalesce(F.col("n_users") > 0, F.lit(False))).alias("saw_users"),
        F.bool_or(F.coalesce(F.col("n_root_open") > 0, F.lit(False))).alias("root_open"),
        present(F.col("has_audit")).alias("saw_audit"),
        some("has_audit").alias("has_audit"),
        F.bool_or(F.coalesce(F.size(tls) > 0, F.lit(False))).alias("saw_tls"),
        F.coalesce(F.bool_or(tls["have_ssl"] == "YES"), F.lit(False)).alias("has_tls"),
        (present(F.col("has_encryption")) | present(F.col("has_keyring"))).alias("saw_encryption"),
        some("has_encryption").alias("has_encryption"),
        present(F.col("has_empty_password")).alias("saw_empty"),
        some("has_empty_password").alias("empty_password"),
        present(F.col("has_old_auth")).alias("saw_old_auth"),
        some("has_old_auth").alias("old_auth"),
        present(F.col("has_login_failures")).alias("saw_logins"),
        some("has_login_failures").alias("login_failures"),
    )


def security_checks(facts: DataFrame, cluster_keys: list[str] = CLUSTER_KEYS) -> DataFrame:
    """Nine checks per cluster: PASS, WARN, FAIL, or UNKNOWN where the evidence was not collected."""
    lead = F.col("lead")
    tls = lead["tls_config"]

    def check(check_id: str, saw: str, passed: Column, otherwise: str = "FAIL") -> Column:
        status = F.when(~F.col(saw), "UNKNOWN").when(F.coalesce(passed, F.lit(False)), "PASS").otherwise(otherwise)
        return F.struct(F.lit(check_id).alias("check_id"), status.alias("status"))

    checks = F.array(
        check("strong_password_policy", "saw_policy", lead["has_password_policy"]),
        check("no_wildcard_root", "saw_users", ~F.col("root_open")),
        check("audit_log", "saw_audit", F.col("has_audit")),
        check("tls_enabled", "saw_tls", S.tls_status(tls["have_ssl"], tls["tls_version"]) == "PASS", "WARN"),
        check("require_secure_transport", "saw_tls", tls["require_secure_transport"] == "ON", "WARN"),
        check("innodb_encryption", "saw_encryption", F.col("has_encryption"), "WARN"),
        check("no_empty_password", "saw_empty", ~F.col("empty_password")),
        check("auth_plugin", "saw_old_auth", ~F.col("old_auth"), "WARN"),
        check("failed_login_baseline", "saw_logins", ~F.col("login_failures"), "WARN"),
    )
    return facts.select(*cluster_keys, F.explode(checks).alias("c")).select(*cluster_keys, "c.*")


def security_level(checks: DataFrame, cluster_keys: list[str] = CLUSTER_KEYS) -> DataFrame:
    counted = checks.groupBy(*cluster_keys).agg(
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PASS", "WARN", "FAIL", "UNKNOWN")],
        F.count(F.lit(1)).alias("total"),
    )
    rate = F.coalesce(F.try_divide(F.col("fail") * 1.0, F.col("total") - F.col("unknown")), F.lit(0.0))
    level = (
        F.when(F.col("unknown") * 2 > F.col("total"), "insufficient")
        .when((F.col("fail") == 0) & (F.col("warn") <= 1), "high")
        .when(rate <= 0.25, "medium")
        .otherwise("low")
    )
    return counted.withColumn("level", level)


def framework_coverage(checks: DataFrame, cluster_keys: list[str] = CLUSTER_KEYS) -> DataFrame:
    """Whether each compliance framework's required checks pass; nine checks per cluster at most."""
    passed = checks.groupBy(*cluster_keys).agg(
        F.collect_set(F.when(F.col("status") == "PASS", F.col("check_id"))).alias("passed")
    )

    def row(name: str, required: list[str], partial: bool) -> Column:
        missing = F.array_except(F.array(*[F.lit(r) for r in required]), F.col("passed"))
        some = F.lit(partial) & (F.size(missing) < len(required))
        status = F.when(F.size(missing) == 0, "met").when(some, "partial").otherwise("not_met")
        return F.struct(
            F.lit(name).alias("framework"), status.alias("status"), F.array_join(missing, ",").alias("missing")
        )

    rows = F.array(*[row(*f) for f in fv.FRAMEWORKS])
    return passed.select(*cluster_keys, F.explode(rows).alias("r")).select(*cluster_keys, "r.*")


def wildcard_users(users: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Accounts open to every host with their danger level."""
    return users.filter(F.col("host") == "%").select(
        *keys,
        "user_name",
        S.wildcard_level("user_name").alias("level"),
        S.wildcard_reason("user_name").alias("reason"),
    )


# Order of danger levels.
LEVELS = ["critical", "high", "medium", "low"]


def wildcard_groups(users: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Open accounts per level and reason; the accounts themselves are in wildcard_users."""
    order = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level"))
    advice = (
        F.when(F.col("level") == "low", "may stay")
        .when(F.col("level") == "medium", "narrow the network")
        .otherwise("restrict now")
    )
    return (
        wildcard_users(users, keys)
        .groupBy(*keys, "level", "reason")
        .agg(F.count(F.lit(1)).alias("n"), F.min("user_name").alias("first_user"), F.max("user_name").alias("last_user"))
        .withColumns({"severity_rank": order.cast("bigint"), "advice": advice})
    )
