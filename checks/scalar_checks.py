"""SCF-*: scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from fleetvitals.functions import fixed_values as fv
from fleetvitals.functions import scalars as S

GIB, MIB = 1073741824, 1048576


def fixed(number: str, unit: int, digits: int, suffix: str) -> str:
    """number/unit with some decimals, rounded half up in integers."""
    scale = 10**digits
    rounded = f"(({number}) * {scale} + {unit // 2}) // {unit}"
    whole = f"CAST(({rounded}) // {scale} AS VARCHAR)"
    if digits == 0:
        return f"concat({whole}, '{suffix}')"
    return f"concat({whole}, '.', lpad(CAST(({rounded}) % {scale} AS VARCHAR), {digits}, '0'), '{suffix}')"


def bytes_text(n: str) -> str:
    return (
        f"CASE WHEN {n} IS NULL THEN '-' WHEN {n} >= {GIB} THEN {fixed(n, GIB, 2, ' GB')} "
        f"WHEN {n} >= {MIB} THEN {fixed(n, MIB, 2, ' MB')} WHEN {n} >= 1024 THEN {fixed(n, 1024, 2, ' KB')} "
        f"ELSE concat(CAST({n} AS VARCHAR), ' B') END"
    )


def any_of(column: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{p}')" for p in patterns) + ")"


SIZES = "SELECT p_partkey AS k, CASE WHEN p_partkey % 50 = 7 THEN NULL WHEN p_partkey % 3 = 0 THEN p_partkey * 1234567 ELSE p_partkey * 97 END AS n FROM part"


def sizes(v):
    k = F.col("p_partkey")
    return v["part"].select(
        k.alias("k"), F.when(k % 50 == 7, None).when(k % 3 == 0, k * 1234567).otherwise(k * 97).alias("n")
    )


@check("scf_01_fmt_bytes", f"SELECT k, {bytes_text('n')} AS txt, CASE WHEN n IS NULL THEN '-' WHEN n >= {GIB} THEN {fixed('n', GIB, 1, ' GB')} "
       f"WHEN n >= {MIB} THEN {fixed('n', MIB, 0, ' MB')} WHEN n >= 1024 THEN {fixed('n', 1024, 0, ' KB')} ELSE concat(CAST(n AS VARCHAR), ' B') END AS short_txt FROM ({SIZES})")
def _(v):
    return sizes(v).select("k", S.fmt_bytes("n").alias("txt"), S.fmt_bytes_short("n").alias("short_txt"))


@check("scf_02_fmt_kb_mb", f"SELECT k, {bytes_text('(n * 1024)')} AS kb, CASE WHEN n IS NULL THEN '-' WHEN n >= 1024 THEN {fixed('n', 1024, 1, ' GB')} ELSE concat(CAST(n AS VARCHAR), ' MB') END AS mb FROM ({SIZES})")
def _(v):
    return sizes(v).select("k", S.fmt_kb("n").alias("kb"), S.format_mb("n").alias("mb"))


@check("scf_03_fmt_seconds", """
SELECT k, CASE WHEN s >= 86400 THEN concat(s // 86400, ' d ', s % 86400 // 3600, ' h ', s % 3600 // 60, ' m')
    WHEN s % 86400 >= 3600 THEN concat(s // 3600, ' h ', s % 3600 // 60, ' m') ELSE concat(s // 60, ' m') END AS txt,
  CASE WHEN s <= 0 THEN '-' WHEN s >= 86400 THEN concat(s // 86400, ' d') WHEN s >= 3600 THEN concat(s // 3600, ' h')
    WHEN s >= 60 THEN concat(s // 60, ' m') ELSE concat(s, ' s') END AS short_txt
FROM (SELECT event_id AS k, event_id * (1 + event_id % 40) AS s FROM events)""")
def _(v):
    k = F.col("event_id")
    s = v["events"].select(k.alias("k"), (k * (1 + k % 40)).alias("s"))
    return s.select(
        "k",
        S.fmt_seconds("s", (" d", " h", " m")).alias("txt"),
        S.uptime_short("s", (" d", " h", " m", " s")).alias("short_txt"),
    )


@check("scf_04_uptime_to_seconds", """
SELECT event_id AS k, CAST(NULLIF((event_id % 200) * 86400 + (event_id % 24) * 3600 + (event_id % 60) * 60 + event_id % 59, 0) AS BIGINT) AS sec FROM events""")
def _(v):
    k = F.col("event_id")
    text = F.format_string("%d days %d hours %d min %d sec", k % 200, k % 24, k % 60, k % 59)
    return v["events"].select(k.alias("k"), S.uptime_to_seconds(text).alias("sec"))


@check("scf_05_human_size_to_bytes", """
SELECT event_id AS k, CAST((event_id % 512) * CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 WHEN 3 THEN 1073741824 ELSE 1099511627776 END AS BIGINT) AS n FROM events""")
def _(v):
    k = F.col("event_id")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("", "K", "M", "g", "TB")]), (k % 5 + 1).cast("int"))
    return v["events"].select(k.alias("k"), S.human_size_to_bytes(F.concat((k % 512).cast("string"), unit)).alias("n"))


@check("scf_06_size_to_mb", """
SELECT event_id AS k, CASE event_id % 4 WHEN 0 THEN n * 1024 WHEN 1 THEN n WHEN 2 THEN n / 1024 ELSE n END AS in_mb,
  CASE event_id % 4 WHEN 0 THEN n * 1024 WHEN 1 THEN n WHEN 2 THEN n / 1024 ELSE n / 1024 END AS in_kb,
  CASE event_id % 4 WHEN 0 THEN n * 1024 WHEN 1 THEN n WHEN 2 THEN n / 1024 ELSE n / 1048576 END AS in_bytes
FROM (SELECT event_id, CAST(event_id % 4096 AS DOUBLE) AS n FROM events)""")
def _(v):
    k = F.col("event_id")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("G", "M", "K", "")]), (k % 4 + 1).cast("int"))
    df = v["events"].select(k.alias("k"), F.concat((k % 4096).cast("string"), unit).alias("s"))
    return df.select(
        "k",
        S.size_to_mb("s", "tmp_table_size_in_mb").alias("in_mb"),
        S.size_to_mb("s", "sort_buffer_size_in_kb").alias("in_kb"),
        S.size_to_mb("s", "max_heap_size").alias("in_bytes"),
    )


@check("scf_07_recommend_buffer_pool", """
SELECT s_suppkey AS k, CASE WHEN m <= 0 THEN NULL ELSE CAST(floor(greatest(1.0::DOUBLE, least(m * 0.6::DOUBLE, m - CASE WHEN m <= 4 THEN 1 WHEN m <= 16 THEN 2 ELSE 4 END)) * 1024 + 0.5) AS BIGINT) END AS mb
FROM (SELECT s_suppkey, CAST(s_suppkey % 300 AS DOUBLE) AS m FROM supplier)""")
def _(v):
    return v["supplier"].select(
        F.col("s_suppkey").alias("k"), S.recommend_buffer_pool_mb((F.col("s_suppkey") % 300).cast("double")).alias("mb")
    )


@check("scf_08_sql_mode_set", """
SELECT k, CASE WHEN sql_mode IS NULL THEN '' ELSE sql_mode END AS modes, coalesce(contains(sql_mode, 'STRICT'), FALSE) AS strict FROM {nodes}""")
def _(v):
    modes = S.sql_mode_set(F.concat(F.lower("sql_mode"), F.lit(" , "), F.lower("sql_mode")))
    return v["nodes"].select(
        "k",
        F.array_join(modes, ",").alias("modes"),
        (F.array_contains(modes, "STRICT_TRANS_TABLES") | F.array_contains(modes, "STRICT_ALL_TABLES")).alias("strict"),
    )


@check("scf_09_is_version_80_plus", "SELECT k, k % 9 IN (3, 4, 5, 6, 7) AS plus FROM {nodes}")
def _(v):
    return v["nodes"].select("k", S.is_version_80_plus("server_version").alias("plus"))


@check("scf_10_number_or_null", """
SELECT event_id AS k, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN event_id * 1000.0::DOUBLE ELSE CAST(event_id AS DOUBLE) END AS n FROM events""")
def _(v):
    k = F.col("event_id")
    text = (
        F.when(k % 5 == 0, "NULL").when(k % 5 == 1, "-").when(k % 5 == 2, "abc")
        .when((k % 5 == 3) & (k > 0), F.concat(k.cast("string"), F.lit(",000"))).otherwise(F.concat(F.lit(" "), k.cast("string")))
    )
    return v["events"].select(k.alias("k"), S.number_or_null(text).alias("n"))


@check("scf_11_normalize_value", """
SELECT event_id AS k, CASE event_id % 3 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN concat(event_id, '.5') ELSE 'ROW' END AS value FROM events""")
def _(v):
    k = F.col("event_id")
    text = (
        F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit(".00000000")))
        .when(k % 3 == 1, F.concat(k.cast("string"), F.lit(".500000")))
        .otherwise(" ROW ")
    )
    return v["events"].select(k.alias("k"), S.normalize_value(text).alias("value"))


@check("scf_12_ip_sort_key", "SELECT k, substr(node_order, 3) AS sort_key FROM {nodes}")
def _(v):
    return v["nodes"].select("k", S.ip_sort_key("node_ip").alias("sort_key"))


@check("scf_13_canonical_role", """
SELECT k, CASE k % 8 WHEN 0 THEN 'primary' WHEN 1 THEN 'primary' WHEN 2 THEN 'dr' WHEN 3 THEN 'dr' WHEN 4 THEN 'slave' WHEN 5 THEN 'slave' WHEN 6 THEN 'dr' ELSE NULL END AS role
FROM {nodes}""")
def _(v):
    names = ["db-PRI-1", "master", "dr_db", "x-standby", "slave7", "my-Replica", "backup-mysql", "plain"]
    text = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("k") % 8 + 1).cast("int"))
    return v["nodes"].select("k", S.canonical_role(text).alias("role"))


@check("scf_14_is_dr", "SELECT k, role = 'dr' OR k % 7 = 0 AS dr FROM {nodes}")
def _(v):
    return v["nodes"].select("k", S.is_dr("role", "hostname", "file_name").alias("dr"))


@check("scf_15_is_metadata_query", f"""
SELECT event_id AS k, event_id % 8 IN (0, 1, 2, 3, 4) OR (event_id % 8 = 5 AND db IS NULL) AS meta
FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'shop' END AS db FROM events)""")
def _(v):
    k = F.col("event_id")
    texts = ["SHOW TABLES", "select * from information_schema.tables", "set names utf8", " COMMIT ", "SELECT * FROM mysql.user",
             "SELECT NOW()", "SELECT * FROM orders", "update t set a = 1"]
    sql = F.element_at(F.array(*[F.lit(t) for t in texts]), (k % 8 + 1).cast("int"))
    db = F.when(k % 3 != 0, "shop")
    return v["events"].select(k.alias("k"), S.is_metadata_query(sql, db).alias("meta"))


def table_names(v):
    return v["cat_tables"].select("k", "table_name")


@check("scf_16_is_temp_or_history_table", f"SELECT k, {any_of('table_name', fv.TEMP_OR_HISTORY_PATTERNS)} AS other FROM {{cat_tables}}")
def _(v):
    return table_names(v).select("k", S.is_temp_or_history_table("table_name").alias("other"))


@check("scf_17_is_ghost_table", "SELECT k, k % 23 = 0 AS ghost FROM {cat_tables}")
def _(v):
    return table_names(v).select("k", S.is_ghost_table("table_name").alias("ghost"))


@check("scf_18_table_category", f"""
SELECT k, CASE WHEN regexp_matches(table_name, '{fv.CATEGORY_TEMP}') THEN 'temp' WHEN regexp_matches(table_name, '{fv.CATEGORY_HISTORY}') THEN 'history'
  WHEN starts_with(table_name, '_') THEN 'temp' ELSE 'business' END AS category FROM {{cat_tables}}""")
def _(v):
    return table_names(v).select("k", S.table_category("table_name").alias("category"))


@check("scf_19_is_archive_table", "SELECT k, k % 11 = 0 AS archive FROM {cat_tables}")
def _(v):
    return table_names(v).select("k", S.is_archive_table("table_name").alias("archive"))


LEVEL_SQL = """CASE WHEN user_name = 'root' OR user_name LIKE 'admin%' THEN 'critical' WHEN user_name LIKE 'backup%' THEN 'high'
  WHEN user_name LIKE 'ro%' THEN 'low' ELSE 'medium' END"""
REASON_SQL = """CASE WHEN user_name = 'root' OR user_name LIKE 'admin%' THEN 'administrator account' WHEN user_name LIKE 'backup%' THEN 'backup account'
  WHEN user_name LIKE 'ro%' THEN 'read-only account' ELSE 'business account' END"""


@check("scf_20_wildcard_level", f"SELECT k, {LEVEL_SQL} AS level, {REASON_SQL} AS reason FROM {{cat_users}}")
def _(v):
    return v["cat_users"].select("k", S.wildcard_level("user_name").alias("level"), S.wildcard_reason("user_name").alias("reason"))


@check("scf_21_score_level", """
SELECT s_suppkey AS k, CASE WHEN s >= 85 THEN 'excellent' WHEN s >= 70 THEN 'good' WHEN s >= 55 THEN 'medium' WHEN s >= 40 THEN 'poor' ELSE 'critical' END AS level
FROM (SELECT s_suppkey, s_suppkey % 101 AS s FROM supplier)""")
def _(v):
    return v["supplier"].select(F.col("s_suppkey").alias("k"), S.score_level(F.col("s_suppkey") % 101).alias("level"))


@check("scf_22_disk_band", """
SELECT cluster_id, node_ip, mount, CASE WHEN use_pct >= 90 THEN 'urgent' WHEN use_pct >= 80 THEN 'attention' WHEN use_pct >= 70 THEN 'normal' ELSE 'ample' END AS band FROM {disks}""")
def _(v):
    return v["disks"].select("cluster_id", "node_ip", "mount", S.disk_band("use_pct").alias("band"))


@check("scf_23_os_lifecycle", """
SELECT k, CASE k % 6 WHEN 0 THEN 'CentOS 6' WHEN 1 THEN 'CentOS 7' WHEN 2 THEN 'CentOS 8' ELSE NULL END AS major,
  CASE WHEN k % 6 IN (0, 1, 2) THEN 'eol' WHEN k % 6 = 4 THEN NULL ELSE 'unknown' END AS status,
  CASE k % 6 WHEN 0 THEN 'P1' WHEN 1 THEN 'P2' WHEN 2 THEN 'P2' WHEN 4 THEN NULL ELSE 'P3' END AS priority FROM {nodes}""")
def _(v):
    life = S.os_lifecycle("os_release")
    return v["nodes"].select("k", life["major"].alias("major"), life["status"].alias("status"), life["priority"].alias("priority"))


@check("scf_24_server_lifecycle", """
SELECT k, CASE k % 9 WHEN 0 THEN '5.5' WHEN 1 THEN '5.6' WHEN 2 THEN '5.7' WHEN 3 THEN '8.0' WHEN 4 THEN '8.4' WHEN 5 THEN '9.x'
    WHEN 6 THEN 'MariaDB 10.x' WHEN 7 THEN 'MariaDB 11.0-11.3' ELSE NULL END AS major,
  CASE WHEN k % 9 IN (0, 1, 2, 6, 7) THEN 'eol' WHEN k % 9 = 3 THEN 'security' WHEN k % 9 IN (4, 5) THEN 'supported' ELSE NULL END AS status,
  CASE k % 9 WHEN 0 THEN 'P0' WHEN 1 THEN 'P0' WHEN 2 THEN 'P1' WHEN 3 THEN 'P3' WHEN 6 THEN 'P2' WHEN 7 THEN 'P2' ELSE NULL END AS priority FROM {nodes}""")
def _(v):
    life = S.server_lifecycle("server_version")
    return v["nodes"].select("k", life["major"].alias("major"), life["status"].alias("status"), life["priority"].alias("priority"))


TLS_SQL = "CASE WHEN have_ssl = 'YES' AND k % 4 = 1 THEN 'PASS' ELSE 'WARN' END"


@check("scf_25_tls_status", f"SELECT k, {TLS_SQL} AS status, coalesce(k % 4 = 0 AND tls_version IS NOT NULL, FALSE) AS weak FROM {{nodes}}")
def _(v):
    return v["nodes"].select("k", S.tls_status("have_ssl", "tls_version").alias("status"), S.tls_weak("tls_version").alias("weak"))


@check("scf_26_truncate_and_dates", """
SELECT o_orderkey AS k, CASE WHEN length(o_orderpriority) > 6 THEN concat(substr(o_orderpriority, 1, 6), '…') ELSE o_orderpriority END AS short_txt,
  strftime(o_orderdate, '%Y年%m月%d日') AS day_label, concat(year(o_orderdate), '年', month(o_orderdate), '月') AS month_label FROM orders""")
def _(v):
    return v["orders"].select(
        F.col("o_orderkey").alias("k"),
        S.truncate("o_orderpriority", 6).alias("short_txt"),
        S.date_label("o_orderdate").alias("day_label"),
        S.month_label("o_orderdate").alias("month_label"),
    )


@check("scf_27_fragment_rate", """
SELECT k, round(CAST(data_free AS DOUBLE) / (data_length + index_length + data_free), 2) AS rate FROM {cat_tables}""")
def _(v):
    return v["cat_tables"].select("k", S.fragment_rate("table_rows", "data_length", "index_length", "data_free").alias("rate"))


AUTO_RATE = """round(CAST(auto_increment AS DOUBLE) / (pow(2.0, CASE data_type WHEN 'tinyint' THEN 7 WHEN 'smallint' THEN 15 WHEN 'mediumint' THEN 23
  WHEN 'int' THEN 31 WHEN 'bigint' THEN 63 END + CASE WHEN column_type LIKE '% unsigned' THEN 1 ELSE 0 END) - 1), 4)"""


@check("scf_28_auto_increment_rate", f"""
SELECT k, {AUTO_RATE} AS rate FROM (SELECT k, coalesce(auto_increment, 17) % 100000 AS auto_increment,
  CASE k % 5 WHEN 0 THEN 'tinyint' WHEN 1 THEN 'smallint' WHEN 2 THEN 'mediumint' WHEN 3 THEN 'int' ELSE 'bigint' END AS data_type,
  CASE WHEN k % 2 = 0 THEN 'x unsigned' ELSE 'x' END AS column_type FROM {{cat_tables}})""")
def _(v):
    k = F.col("k")
    kinds = F.array(*[F.lit(t) for t in ("tinyint", "smallint", "mediumint", "int", "bigint")])
    kind = F.element_at(kinds, (k % 5 + 1).cast("int"))
    return v["cat_tables"].select(
        "k",
        S.auto_increment_rate(
            F.coalesce("auto_increment", F.lit(17)) % 100000, kind, F.when(k % 2 == 0, "x unsigned").otherwise("x")
        ).alias("rate"),
    )


@check("scf_29_login_ip", "SELECT event_id AS k, concat('10.0.', user_id % 20, '.5') AS login_ip FROM events")
def _(v):
    return v["sessions"].select(F.col("session_id").alias("k"), S.login_ip("host").alias("login_ip"))


@check("scf_30_clean_path", """
SELECT s_suppkey AS k, concat('/data/backup', s_suppkey) AS path, concat('/opt/jobs', s_suppkey, '|/var/dump') AS named FROM supplier""")
def _(v):
    k = F.col("s_suppkey").cast("string")
    cron = F.concat(F.lit("0 3 * * * /opt/jobs"), k, F.lit("/full_backup.sh > /var/dump/; /opt/mysqlop.py"))
    return v["supplier"].select(
        F.col("s_suppkey").alias("k"),
        S.clean_path(F.concat(F.lit(" /data/backup"), k, F.lit("//');"))).alias("path"),
        F.array_join(S.paths_in_text(cron), "|").alias("named"),
    )
