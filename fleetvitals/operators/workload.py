"""Sessions, locks, engine counters and statement digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetvitals import KEYS
from fleetvitals.functions import fixed_values as fv
from fleetvitals.functions import scalars as S
from fleetvitals.functions.statements import digest_text
from fleetvitals.operators.ranking import first_k, top_k


def processlist(sessions: DataFrame, own_session: Column | None = None) -> DataFrame:
    """All sessions; the inspecting session itself can be excluded. A reader orders them by time_s, longest first."""
    return sessions if own_session is None else sessions.filter(F.col("session_id") != own_session)


def active_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.filter(F.col("command") != "Sleep")


def foreground_threads(threads: DataFrame) -> DataFrame:
    return threads.filter((F.col("type") != "BACKGROUND") & (F.col("command") != "Sleep"))


def top_sleep(sessions: DataFrame, keys: list[str] = KEYS, k: int = 20) -> DataFrame:
    return top_k(
        sessions.filter(F.col("command") == "Sleep"), keys, [F.desc("time_s"), F.asc("session_id")], k
    )


def is_long_business_session(min_s: int = 60) -> Column:
    """A session of a user that has run long and is no replication or daemon thread."""
    user = F.coalesce(F.col("user_name"), F.lit(""))
    state = F.coalesce(F.col("state"), F.lit(""))
    command = F.coalesce(F.col("command"), F.lit(""))
    replication = (user == "system user") | state.rlike(fv.REPLICATION_STATE)
    daemon = user.rlike(fv.DAEMON_USER) | state.rlike(fv.DAEMON_STATE)
    quiet = (F.lower(command) == "sleep") | command.rlike("(?i)binlog")
    return (F.col("time_s") >= min_s) & ~quiet & ~replication & ~daemon


def long_sessions(sessions: DataFrame, min_s: int = 60) -> DataFrame:
    return sessions.filter(is_long_business_session(min_s))


def tables_in_use(open_tables: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return open_tables.filter(F.col("in_use") > 0).select(*keys, "table_schema", "table_name", "in_use")


def lock_tables(df: DataFrame, order: list[str], keys: list[str] = KEYS, k: int | None = None) -> DataFrame:
    """Rows of a lock table; with k, the first ones per node."""
    return first_k(df, keys, [F.asc(c) for c in order], k)


def lock_waits(waits: DataFrame, trx: DataFrame, keys: list[str] = KEYS, k: int | None = None) -> DataFrame:
    """Waiting and blocking transaction of each lock wait, with their statements.

    Both joins are on the transaction id as well as the node, so a node with
    many waits still spreads over its transactions.
    """

    def side(name: str) -> DataFrame:
        return trx.select(
            *keys,
            F.col("trx_id").alias(f"{name}_trx_id"),
            F.col("thread_id").alias(f"{name}_thread"),
            F.col("query").alias(f"{name}_query"),
        )

    joined = (
        waits.select(*keys, "waiting_trx_id", "blocking_trx_id")
        .join(side("blocking"), [*keys, "blocking_trx_id"])
        .join(side("waiting"), [*keys, "waiting_trx_id"])
    )
    return first_k(joined, keys, [F.asc("waiting_trx_id"), F.asc("blocking_trx_id")], k)


def lock_counters(status: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return status.filter(F.lower("name").contains("lock")).select(*keys, "name", "value")


def engine_metrics(metrics: DataFrame, keys: list[str] = KEYS, k: int = 80) -> DataFrame:
    kept = metrics.filter((F.col("status") == "enabled") & F.col("subsystem").isin(fv.METRIC_SUBSYSTEMS))
    return top_k(
        kept.select(*keys, "name", "metric_count", "subsystem"), keys, [F.desc("metric_count"), F.asc("name")], k
    )


def buffer_pool_stats(pools: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Pools of a node added up; the hit rate is the mean over its pools."""
    return pools.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pools"),
        *[
            F.sum(c).cast("bigint").alias(c)
            for c in ("pool_size", "free_buffers", "database_pages", "modified_database_pages")
        ],
        (F.sum("hit_rate") / F.count("hit_rate")).alias("hit_rate"),
    )


def status_subset(status: DataFrame, names: list[str] | None = None, keys: list[str] = KEYS) -> DataFrame:
    """Wide row per node. The pivot lists its values, so no extra job looks for them."""
    wanted = names or fv.STATUS_COUNTERS
    return (
        status.filter(F.col("name").isin(wanted))
        .groupBy(*keys)
        .pivot("name", wanted)
        .agg(F.max(F.col("value").try_cast("bigint")))
    )


def digest_statements(statements: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Statement events rolled up by digest. Sums combine map-side, so a hot digest is cheap."""
    digested = statements.withColumn("query", digest_text("sql"))
    rolled = digested.groupBy(*keys, "db", "query").agg(
        F.count(F.lit(1)).alias("exec_count"),
        F.sum("latency_us").cast("bigint").alias("total_us"),
        F.max("latency_us").cast("bigint").alias("max_us"),
        *[F.sum(c).cast("bigint").alias(c) for c in DIGEST_SUMS if c in statements.columns],
        F.min("seen_at").alias("first_seen"),
        F.max("seen_at").alias("last_seen"),
    )
    return _identified(rolled)


DIGEST_SUMS = ["rows_examined", "rows_sent", "no_index", "tmp_tables", "tmp_disk", "sort_rows", "errors", "warnings"]


def _identified(rolled: DataFrame) -> DataFrame:
    return rolled.withColumn("digest", F.md5(F.concat_ws("|", F.coalesce("db", F.lit("")), "query"))).withColumn(
        "avg_us", F.col("total_us") / F.col("exec_count")
    )


def merge_digests(roll_ups: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Roll-ups of parts of the statements as one roll-up of all of them: every figure adds up, or is an extreme."""
    rolled = roll_ups.groupBy(*keys, "db", "query").agg(
        F.sum("exec_count").cast("bigint").alias("exec_count"),
        F.sum("total_us").cast("bigint").alias("total_us"),
        F.max("max_us").alias("max_us"),
        *[F.sum(c).cast("bigint").alias(c) for c in DIGEST_SUMS if c in roll_ups.columns],
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )
    return _identified(rolled)


def logged_statements(entries: DataFrame) -> DataFrame:
    """Slow-log entries as statement events."""
    return entries.withColumns({"latency_us": F.round(F.col("query_s") * 1_000_000).cast("bigint"), "seen_at": F.col("time")})


def _user_digests(digests: DataFrame) -> DataFrame:
    return digests.filter(F.col("db").isNull() | S.outside_system_schemas("db"))


def _avg() -> Column:
    return F.col("total_us") / F.col("exec_count")


def top_by_total_latency(digests: DataFrame, keys: list[str] = KEYS, k: int = 20) -> DataFrame:
    top = top_k(_user_digests(digests), keys, [F.desc("total_us"), F.asc("digest")], k)
    ratio = F.round(F.try_divide(F.col("rows_examined") * 1.0, F.col("rows_sent")), 1)
    return top.withColumn("avg_us", _avg()).withColumn("examined_per_sent", ratio)


def top_by_count(digests: DataFrame, keys: list[str] = KEYS, k: int = 20) -> DataFrame:
    top = top_k(_user_digests(digests), keys, [F.desc("exec_count"), F.asc("digest")], k)
    return top.withColumn("avg_us", _avg())


def top_by_avg_latency(
    digests: DataFrame, keys: list[str] = KEYS, min_count: int = 10, k: int = 20
) -> DataFrame:
    kept = _user_digests(digests).filter(F.col("exec_count") > min_count).withColumn("avg_us", _avg())
    return top_k(kept, keys, [F.desc("avg_us"), F.asc("digest")], k)


def _pct(part: str, whole: str) -> Column:
    return F.floor(F.coalesce(F.try_divide(F.col(part) * 100.0, F.col(whole)), F.lit(0.0)) + 0.5).cast("bigint")


def temp_table_statements(digests: DataFrame, keys: list[str] = KEYS, k: int = 20) -> DataFrame:
    kept = digests.filter(F.col("tmp_tables") > 0)
    order = [F.desc("tmp_disk"), F.desc("tmp_tables"), F.asc("digest")]
    return top_k(kept, keys, order, k).withColumn("disk_pct", _pct("tmp_disk", "tmp_tables"))


def disk_sort_statements(digests: DataFrame, keys: list[str] = KEYS, k: int = 20) -> DataFrame:
    kept = digests.filter(F.col("sort_rows") > 0)
    return top_k(kept, keys, [F.desc("total_us"), F.asc("digest")], k)


def no_index_statements(digests: DataFrame, keys: list[str] = KEYS, k: int = 20) -> DataFrame:
    """Statements that run without a good index, ordered by numeric latency within a share."""
    kept = digests.filter(((F.col("no_index") > 0) | (F.col("no_good_index") > 0)) & ~F.col("query").like("SHOW%"))
    rated = kept.withColumn("no_index_pct", _pct("no_index", "exec_count")).withColumn(
        "avg_rows_examined", F.floor(F.col("rows_examined") / F.col("exec_count") + 0.5).cast("bigint")
    )
    return top_k(rated, keys, [F.desc("no_index_pct"), F.desc("total_us"), F.asc("digest")], k)


def error_statements(digests: DataFrame, keys: list[str] = KEYS, k: int = 20) -> DataFrame:
    kept = digests.filter((F.col("errors") > 0) | (F.col("warnings") > 0))
    return top_k(kept, keys, [F.desc("errors"), F.desc("warnings"), F.asc("digest")], k)


def slow_log_summary(entries: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return entries.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.max("query_s").alias("max_query_s"),
        F.avg("query_s").alias("avg_query_s"),
        F.max("rows_examined").alias("max_rows_examined"),
        F.min("time").alias("first_time"),
        F.max("time").alias("last_time"),
    )


def slow_log_top(entries: DataFrame, keys: list[str] = KEYS, k: int = 20) -> DataFrame:
    short = entries.withColumn("sql", F.substring(F.trim("sql"), 1, 400))
    return top_k(short, keys, [F.desc("query_s"), F.asc("time"), F.asc("sql")], k)


def error_log_summary(lines: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return lines.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(F.col("severity") == "error").alias("n_errors"),
        F.count_if(F.col("severity") == "warning").alias("n_warnings"),
        F.count_if(F.col("severity") == "lifecycle").alias("n_lifecycle"),
    )


def error_log_tail(lines: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The last lines of each severity: 20 errors, 10 warnings, 20 lifecycle events."""
    ranked = top_k(lines.filter(F.col("severity").isNotNull()), [*keys, "severity"], [F.desc("line_no")], 20)
    return ranked.filter((F.col("severity") != "warning") | (F.col("rnk") <= 10))
