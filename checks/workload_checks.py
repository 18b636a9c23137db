"""SES-*, ENG-*, SQL-*: sessions, engine counters, statements and logs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.catalog_checks import K, plain, topk
from checks.registry import check
from fleetvitals import KEYS
from fleetvitals.functions import fixed_values as fv
from fleetvitals.operators import workload as W
from fleetvitals.plans.lineage import shared_folder
from fleetvitals.streaming import digests

SESSION = f"{K}, session_id, user_name, host, db, command, time_s, state"
LONG = """time_s >= 60 AND command NOT IN ('Sleep', 'Binlog Dump') AND user_name NOT IN ('system user', 'event_scheduler')
  AND state NOT IN ('Waiting for master to send event', 'Waiting on empty queue')"""


@check("ses_01_processlist", f"SELECT {SESSION} FROM {{sessions}}")
def _(v):
    return plain(W.processlist(v["sessions"]))


@check("ses_02_active_sessions", f"SELECT {SESSION} FROM {{sessions}} WHERE command <> 'Sleep'")
def _(v):
    return plain(W.active_sessions(v["sessions"]))


@check("ses_02_foreground_threads", f"SELECT {K}, thread_id, name, type, command, state FROM {{threads}} WHERE type <> 'BACKGROUND' AND command <> 'Sleep'")
def _(v):
    return plain(W.foreground_threads(v["threads"]))


@check("ses_03_top_sleep", topk(SESSION, "{sessions}", "command = 'Sleep'", "time_s DESC, session_id", 20))
def _(v):
    return plain(W.top_sleep(v["sessions"]))


@check("ses_04_long_sessions", f"SELECT {SESSION} FROM {{sessions}} WHERE {LONG}")
def _(v):
    return plain(W.long_sessions(v["sessions"]))


@check("ses_05_tables_in_use", f"SELECT {K}, table_schema, table_name, in_use FROM {{open_tables}} WHERE in_use > 0")
def _(v):
    return plain(W.tables_in_use(v["open_tables"]))


@check("ses_06_lock_rows", f"SELECT {K}, waiting_trx_id AS lock_trx_id, concat('t', CAST(substr(waiting_trx_id, 2) AS BIGINT) % 7) AS lock_table FROM {{lock_wait_rows}}")
def _(v):
    """The locks that transactions hold or wait for, of any number per node."""
    number = F.substring("waiting_trx_id", 2, 30).cast("bigint")
    locks = v["lock_wait_rows"].select(*KEYS, F.col("waiting_trx_id").alias("lock_trx_id"), F.concat(F.lit("t"), (number % 7).cast("string")).alias("lock_table"))
    return plain(W.lock_tables(locks, ["lock_trx_id", "lock_table"]))


@check("ses_06_transactions", f"SELECT {K}, trx_id, thread_id, query FROM {{trx}}")
def _(v):
    return plain(W.lock_tables(v["trx"], ["trx_id"]))


@check("ses_06_lock_waits", f"SELECT {K}, waiting_trx_id, blocking_trx_id FROM {{lock_wait_rows}}")
def _(v):
    return plain(W.lock_tables(v["lock_wait_rows"], ["waiting_trx_id"]))


@check("ses_06_metadata_locks", topk(f"{K}, table_schema, table_name, in_use", "{open_tables}", "TRUE", "table_schema, table_name", 5))
def _(v):
    """A report that asks for the first rows only."""
    return plain(W.lock_tables(v["open_tables"], ["table_schema", "table_name"], k=5))


@check("ses_07_lock_waits", f"""
WITH w AS (SELECT w.cluster_id, w.node_ip, waiting_trx_id, r.thread_id AS waiting_thread, r.query AS waiting_query,
  blocking_trx_id, b.thread_id AS blocking_thread, b.query AS blocking_query
FROM {{lock_wait_rows}} w JOIN {{trx}} b ON b.cluster_id = w.cluster_id AND b.trx_id = w.blocking_trx_id
JOIN {{trx}} r ON r.cluster_id = w.cluster_id AND r.trx_id = w.waiting_trx_id)
SELECT * FROM w""")
def _(v):
    return plain(W.lock_waits(v["lock_wait_rows"], v["trx"]))


@check("ses_08_lock_counters", f"SELECT {K}, name, value FROM {{status}} WHERE name ILIKE '%lock%'")
def _(v):
    return plain(W.lock_counters(v["status"]))


@check("eng_01_engine_metrics", topk(
    f"{K}, name, metric_count, subsystem", "{engine_counters}", "status = 'enabled' AND subsystem IN ('buffer', 'lock', 'log')", "metric_count DESC, name", 80))
def _(v):
    return plain(W.engine_metrics(v["engine_counters"]))


@check("eng_02_buffer_pool_stats", f"""
SELECT {K}, count(*) AS n_pools, CAST(sum(pool_size) AS BIGINT) AS pool_size, CAST(sum(free_buffers) AS BIGINT) AS free_buffers,
  CAST(sum(database_pages) AS BIGINT) AS database_pages, CAST(sum(modified_database_pages) AS BIGINT) AS modified_database_pages, avg(hit_rate) AS hit_rate
FROM {{buffer_pools}} GROUP BY {K}""")
def _(v):
    return plain(W.buffer_pool_stats(v["buffer_pools"]))


def counter(name: str) -> str:
    return f'CAST(max(CASE WHEN name = \'{name}\' THEN CAST(value AS BIGINT) END) AS BIGINT) AS "{name}"'


@check("eng_03_status_subset", f"SELECT {K}, {', '.join(counter(n) for n in fv.STATUS_COUNTERS)} FROM {{status}} WHERE name IN ({', '.join(repr(n) for n in fv.STATUS_COUNTERS)}) GROUP BY {K}")
def _(v):
    return plain(W.status_subset(v["status"]))


@check("sql_00_digest_statements", f"""
WITH d AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(sql, '''[^'']*''', '?', 'g'), '\\b\\d+(\\.\\d+)?\\b', '?', 'g'), '\\s+', ' ', 'g')) AS query FROM {{statements}})
SELECT {K}, db, query, count(*) AS exec_count, CAST(sum(latency_us) AS BIGINT) AS total_us, max(latency_us) AS max_us, CAST(sum(rows_examined) AS BIGINT) AS rows_examined,
  CAST(sum(rows_sent) AS BIGINT) AS rows_sent, CAST(sum(no_index) AS BIGINT) AS no_index, min(seen_at) AS first_seen, max(seen_at) AS last_seen,
  md5(concat(db, '|', query)) AS digest, CAST(sum(latency_us) AS DOUBLE) / count(*) AS avg_us
FROM d GROUP BY {K}, db, query""")
def _(v):
    return plain(W.digest_statements(v["statements"]))


# The same statement in many spellings: lists of 2 to 6 values, other literals, comments, letters and white space.
VARIANT_FORMS = ["SELECT a, b FROM t{m} WHERE id IN (...) AND c = ?", "INSERT INTO t{m} (`key {m}`, v) VALUES (...) /* , ... */", "UPDATE t{m} SET a = ?, b = ?, c = ? WHERE d = ?"]
FORM = "CASE o_orderkey % 4 " + " ".join(
    "WHEN {} THEN concat('{}')".format(i, VARIANT_FORMS[max(i - 1, 0)].replace("{m}", "', o_custkey % 3, '")) for i in range(4)
) + " END"


def spelt(v):
    """Four spellings of three statements, by the order's number."""
    k, m = F.col("o_orderkey").cast("string"), (F.col("o_custkey") % 3).cast("string")
    numbers = F.transform(F.sequence(F.lit(0), (F.col("o_orderkey") % 5 + 1).cast("int")), lambda x: F.concat(k, x.cast("string")))
    pairs = F.transform(numbers, lambda x: F.concat(F.lit("("), x, F.lit(", 'it''s "), k, F.lit("')")))

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    select = text("SELECT a, b\n FROM t", m, " WHERE id IN (", F.array_join(numbers, ", "), ") AND c = 'it''s \\' ", k, "'")
    small = text("select a, b from t", m, " -- request ", k, "\n where id in(", F.array_join(numbers, ","), ") and c = \"-- ", k, "\"")
    insert = text("INSERT INTO t", m, " (`key ", m, "`, v) VALUES ", F.array_join(pairs, " , "), ";")
    update = text("UPDATE /* node ", k, " */ t", m, " SET a = -", k, ".5e-3, b = 0xF", m, ", c = NULL WHERE d = x'", k, "' # end")
    kind = F.col("o_orderkey") % 4
    return v["orders"].select(
        (F.col("o_custkey") % 25).alias("cluster_id"), F.lit("2024-01-31").cast("date").alias("snapshot_date"), F.lit("10.0.0.1").alias("node_ip"),
        F.lit("shop").alias("db"), F.when(kind == 0, select).when(kind == 1, small).when(kind == 2, insert).otherwise(update).alias("sql"),
        F.col("o_orderkey").alias("latency_us"), F.col("o_orderdate").cast("date").alias("seen_at"))


@check("sql_00_digest_variants", f"""
SELECT CAST(o_custkey % 25 AS BIGINT) AS cluster_id, {FORM} AS query, count(*) AS exec_count, CAST(sum(o_orderkey) AS BIGINT) AS total_us FROM orders GROUP BY 1, 2""")
def _(v):
    return W.digest_statements(spelt(v)).select("cluster_id", "query", "exec_count", "total_us")


def logs(v, half: int):
    """Half of the statements as slow logs, in a folder per node: (cluster, ip, value)."""
    entry = F.concat(
        F.lit("# Time: "), F.date_format("seen_at", "yyyy-MM-dd"), F.lit("\n# User@Host: a[a] @ [x]\n# Query_time: "),
        (F.col("latency_us").cast("decimal(19,0)") * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(25,6)").cast("string"),
        F.lit("  Lock_time: 0.1 Rows_sent: "), F.col("rows_sent").cast("string"), F.lit("  Rows_examined: "), F.col("rows_examined").cast("string"),
        F.lit("\nuse "), F.col("db"), F.lit(";\n"), F.col("sql"), F.lit(";"))
    some = v["statements"].where(F.col("latency_us") % 2 == half)
    return some.select(F.concat(F.lit("c"), F.col("cluster_id").cast("string")).alias("cluster"), F.col("node_ip").alias("ip"), entry.alias("value"))


@check("sql_00_roll_up_over_time", """
WITH d AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(sql, '''[^'']*''', '?', 'g'), '\\b\\d+(\\.\\d+)?\\b', '?', 'g'), '\\s+', ' ', 'g')) AS query FROM {statements})
SELECT concat('cluster=c', cluster_id) AS cluster_id, node_ip, db, query, count(*) AS exec_count, CAST(sum(latency_us) AS BIGINT) AS total_us, max(latency_us) AS max_us,
  CAST(sum(rows_examined) AS BIGINT) AS rows_examined, CAST(sum(rows_sent) AS BIGINT) AS rows_sent, CAST(min(seen_at) AS VARCHAR) AS first_seen, CAST(max(seen_at) AS VARCHAR) AS last_seen
FROM d GROUP BY ALL""")
def _(v):
    """Slow logs that arrive in two halves, one after the other, equal one batch over all of them."""
    path = f"{shared_folder(v.spark)}/slow-logs-{uuid.uuid4().hex}"
    for half in (0, 1):
        logs(v, half).write.partitionBy("cluster", "ip").text(f"{path}/logs/half={half}")
        totals = digests.roll_up_new_logs(v.spark, f"{path}/logs", f"{path}/totals", f"{path}/state")
    return totals.drop("digest", "avg_us")


DIGEST = f"{K}, digest, db, query, exec_count, total_us, max_us, rows_examined, rows_sent, no_index, no_good_index, tmp_tables, tmp_disk, sort_rows, sort_merges, errors, warnings"
OWN = "(db IS NULL OR db <> 'mysql')"
AVG = "CAST(total_us AS DOUBLE) / exec_count"


@check("sql_01_top_by_total_latency", topk(
    f"{DIGEST}, {AVG} AS avg_us, CASE WHEN rows_sent = 0 THEN NULL ELSE CAST(round(CAST(rows_examined AS DOUBLE) / rows_sent, 1) AS DOUBLE) END AS examined_per_sent",
    "{digests}", OWN, "total_us DESC, digest", 20))
def _(v):
    df = plain(W.top_by_total_latency(v["digests"]))
    return df.withColumn("examined_per_sent", F.col("examined_per_sent").cast("double"))


@check("sql_02_top_by_count", topk(f"{DIGEST}, {AVG} AS avg_us", "{digests}", OWN, "exec_count DESC, digest", 20))
def _(v):
    return plain(W.top_by_count(v["digests"]))


@check("sql_03_top_by_avg_latency", topk(f"{DIGEST}, {AVG} AS avg_us", "{digests}", f"{OWN} AND exec_count > 10", f"{AVG} DESC, digest", 20))
def _(v):
    return plain(W.top_by_avg_latency(v["digests"]))


@check("sql_04_temp_table_statements", topk(
    f"{DIGEST}, CAST(floor(tmp_disk * 100.0 / tmp_tables + 0.5) AS BIGINT) AS disk_pct", "{digests}", "tmp_tables > 0", "tmp_disk DESC, tmp_tables DESC, digest", 20))
def _(v):
    return plain(W.temp_table_statements(v["digests"]))


@check("sql_05_disk_sort_statements", topk(DIGEST, "{digests}", "sort_rows > 0", "total_us DESC, digest", 20))
def _(v):
    return plain(W.disk_sort_statements(v["digests"]))


PCT = "CAST(floor(no_index * 100.0 / exec_count + 0.5) AS BIGINT)"


@check("sql_06_no_index_statements", topk(
    f"{DIGEST}, {PCT} AS no_index_pct, CAST(floor(CAST(rows_examined AS DOUBLE) / exec_count + 0.5) AS BIGINT) AS avg_rows_examined", "{digests}",
    "(no_index > 0 OR no_good_index > 0) AND query NOT LIKE 'SHOW%'", f"{PCT} DESC, total_us DESC, digest", 20))
def _(v):
    return plain(W.no_index_statements(v["digests"]))


@check("sql_07_error_statements", topk(DIGEST, "{digests}", "errors > 0 OR warnings > 0", "errors DESC, warnings DESC, digest", 20))
def _(v):
    return plain(W.error_statements(v["digests"]))
