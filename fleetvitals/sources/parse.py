"""Section texts to typed tables and to one node_facts row per dump.

All of it is projection: no shuffle, no Python UDF. The per-line structures
of one dump live in arrays of that dump's row and are exploded on demand. Costly
arrays are exploded with explode_outer and a filter on the result: a plain
explode makes the optimizer add a size() test that computes the array twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetvitals import KEYS
from fleetvitals.functions import fixed_values as fv
from fleetvitals.functions import scalars as S
from fleetvitals.sources import ingest

# Section -> (output table, columns). A column is
# (name, position, type, header names that identify it in newer collectors).
TABLE_SPECS: dict[str, tuple[str, list[tuple[str, int, str, tuple[str, ...]]]]] = {
    "databases": ("database CHARACTER", [
        ("name", 0, "string", ("schema_name",)),
        ("charset", 1, "string", ("default_character_set_name",)),
        ("collation", 2, "string", ("default_collation_name",)),
    ]),
    "db_sizes": ("DB TOTAL SIZE", [
        ("name", 0, "string", ("database_name",)),
        ("size_gb", 1, "double", ("database size gb",)),
    ]),
    "top_tables": ("Top 10 Tables", [
        ("table_schema", 0, "string", ("table_schema",)),
        ("table_name", 1, "string", ("table_name",)),
        ("size_gb", 2, "double", ("size(gb)",)),
        ("table_rows", 3, "bigint", ("table_rows",)),
        ("engine", 4, "string", ("engine",)),
    ]),
    "frag_tables": ("Tables fragment rate", [
        ("table_schema", 0, "string", ("table_schema",)),
        ("table_name", 1, "string", ("table_name",)),
        ("table_rows", 2, "bigint", ("table_rows",)),
        ("data_length", 3, "bigint", ("data_length",)),
        ("index_length", 4, "bigint", ("index_length",)),
        ("data_free", 5, "bigint", ("data_free",)),
        ("frag_rate", 6, "double", ("fragment_rate",)),
    ]),
    "non_utf8_tables": ("Not utf8 table", [
        ("table_schema", 0, "string", ("table_schema",)),
        ("table_name", 1, "string", ("table_name",)),
        ("table_collation", 2, "string", ("table_collation",)),
    ]),
    "no_pk_tables": ("NO PRIMARY KEY TABLES", [
        ("table_schema", 0, "string", ("table_schema",)),
        ("table_name", 1, "string", ("table_name",)),
    ]),
    "users": ("user check", [
        ("user_name", 0, "string", ("user",)),
        ("host", 1, "string", ("host",)),
        ("password_expired", 2, "string", ("password_expired",)),
        ("password_last_changed", 3, "string", ("password_last_changed",)),
        ("password_lifetime", 4, "string", ("password_lifetime",)),
        ("account_locked", 5, "string", ("account_locked",)),
    ]),
    "sessions": ("Processlist info", [
        ("session_id", 0, "bigint", ("id",)),
        ("user_name", 1, "string", ("user",)),
        ("host", 2, "string", ("host",)),
        ("db", 3, "string", ("db",)),
        ("command", 4, "string", ("command",)),
        ("time_s", 5, "bigint", ("time",)),
        ("state", 6, "string", ("state",)),
        ("info", 7, "string", ("info",)),
    ]),
    "large_columns": ("BLOB info", [
        ("table_schema", 0, "string", ("table_schema",)),
        ("table_name", 1, "string", ("table_name",)),
        ("column_name", 2, "string", ("column_name",)),
        ("data_type", 3, "string", ("data_type",)),
    ]),
    "partition_tables": ("PARTITIONS table", [
        ("table_schema", 0, "string", ("table_schema",)),
        ("table_name", 1, "string", ("table_name",)),
        ("n_partitions", 2, "bigint", ("partition_count",)),
    ]),
    "routines": ("ROUTINES OBJECTS", [
        ("routine_schema", 0, "string", ("routine_schema",)),
        ("routine_name", 1, "string", ("routine_name",)),
        ("routine_type", 2, "string", ("routine_type",)),
        ("definer", 3, "string", ("definer",)),
    ]),
    "object_counts": ("Database objects summary", [
        ("db", 0, "string", ("db_name",)),
        ("object_type", 1, "string", ("ob_type",)),
        ("cnt", 2, "bigint", ("sums",)),
    ]),
    "top_indexes": ("Top 10 Index Size", [
        ("table_schema", 0, "string", ("database_name",)),
        ("table_name", 1, "string", ("table_name",)),
        ("index_name", 2, "string", ("index_name",)),
        ("size_mb", 3, "double", ("sizemb",)),
        ("index_type", 5, "string", ("index_type",)),
        ("columns", 6, "string", ("column_name",)),
    ]),
    "auto_increment": ("auto_increment usage", [
        ("table_schema", 0, "string", ("table_schema",)),
        ("table_name", 1, "string", ("table_name",)),
        ("column_name", 2, "string", ("column_name",)),
        ("auto_increment", 3, "decimal(20,0)", ("auto_increment",)),
        ("rate", 4, "double", ("auto_increment_rate",)),
    ]),
    "sql_by_latency": ("TOP 20 SQL by total latency", [
        ("query", 0, "string", ("query",)),
        ("db", 1, "string", ("db",)),
        ("exec_count", 2, "bigint", ("exec_count",)),
        ("total_latency", 3, "string", ("total_latency",)),
        ("avg_latency", 4, "string", ("avg_latency",)),
        ("max_latency", 5, "string", ("max_latency",)),
        ("rows_examined", 6, "bigint", ("rows_examined",)),
        ("rows_sent", 7, "bigint", ("rows_sent",)),
        ("digest", 11, "string", ("digest",)),
    ]),
    "sql_by_count": ("TOP 20 SQL by exec count", [
        ("query", 0, "string", ("query",)),
        ("db", 1, "string", ("db",)),
        ("exec_count", 2, "bigint", ("exec_count",)),
        ("total_latency", 3, "string", ("total_latency",)),
        ("avg_latency", 4, "string", ("avg_latency",)),
    ]),
    "sql_by_average": ("TOP 20 SQL by avg latency", [
        ("query", 0, "string", ("query",)),
        ("db", 1, "string", ("db",)),
        ("exec_count", 2, "bigint", ("exec_count",)),
        ("avg_latency", 3, "string", ("avg_latency",)),
        ("total_latency", 4, "string", ("total_latency",)),
    ]),
    "sql_no_good_index": ("SQL no good index", [
        ("query", 0, "string", ("query",)),
        ("db", 1, "string", ("db",)),
        ("exec_count", 2, "bigint", ("exec_count",)),
        ("total_latency", 3, "string", ("total_latency",)),
        ("no_index_count", 4, "bigint", ("no_index_count",)),
        ("no_good_index_count", 5, "bigint", ("no_good_index_count",)),
        ("no_index_pct", 6, "bigint", ("no_index_pct",)),
    ]),
    "sql_with_temp": ("SQL with temp tables", [
        ("query", 0, "string", ("query",)),
        ("db", 1, "string", ("db",)),
        ("exec_count", 2, "bigint", ("exec_count",)),
        ("total_latency", 3, "string", ("total_latency",)),
        ("memory_tmp", 4, "bigint", ("memory_tmp",)),
        ("disk_tmp", 5, "bigint", ("disk_tmp",)),
        ("disk_pct", 6, "bigint", ("tmp_disk_pct",)),
    ]),
    "unused_indexes": ("Schema unused indexes", [
        ("table_schema", 0, "string", ("object_schema",)),
        ("table_name", 1, "string", ("object_name",)),
        ("index_name", 2, "string", ("index_name",)),
    ]),
    "redundant_indexes": ("Schema redundant indexes", [
        ("table_schema", 0, "string", ("table_schema",)),
        ("table_name", 1, "string", ("table_name",)),
        ("redundant_index", 2, "string", ("redundant_index_name",)),
        ("redundant_columns", 3, "string", ("redundant_index_columns",)),
        ("redundant_non_unique", 4, "bigint", ("redundant_index_non_unique",)),
        ("dominant_index", 5, "string", ("dominant_index_name",)),
        ("dominant_columns", 6, "string", ("dominant_index_columns",)),
        ("dominant_non_unique", 7, "bigint", ("dominant_index_non_unique",)),
        ("drop_sql", 9, "string", ("sql_drop_index",)),
    ]),
    "lock_counters": ("Lock status counters", [
        ("name", 0, "string", ("variable_name",)),
        ("value", 1, "string", ("variable_value",)),
    ]),
    "lock_details": ("LOCK DETAILS", [
        ("waiting_trx_id", 0, "string", ("waiting_trx_id",)),
        ("waiting_thread", 1, "string", ("waiting_thread",)),
        ("waiting_query", 2, "string", ("waiting_query",)),
        ("blocking_trx_id", 3, "string", ("blocking_trx_id",)),
        ("blocking_thread", 4, "string", ("blocking_thread",)),
        ("blocking_query", 5, "string", ("blocking_query",)),
    ]),
    "empty_password_users": ("Users with empty password", [
        ("user_name", 0, "string", ("user",)),
        ("host", 1, "string", ("host",)),
    ]),
    "old_auth_users": ("Users with old auth plugin", [
        ("user_name", 0, "string", ("user",)),
        ("host", 1, "string", ("host",)),
        ("plugin", 2, "string", ("plugin",)),
    ]),
    "failed_logins": ("failed login attempts", [
        ("ip", 0, "string", ("ip",)),
        ("host", 1, "string", ("host",)),
        ("connect_errors", 2, "bigint", ("sum_connect_errors",)),
        ("handshake_errors", 3, "bigint", ("count_handshake_errors",)),
        ("auth_errors", 4, "bigint", ("count_authentication_errors",)),
    ]),
}

SQL_TABLES = ["sql_by_latency", "sql_by_count", "sql_by_average", "sql_no_good_index", "sql_with_temp"]

# Sections whose raw rows are kept.
LOCK_SECTIONS = ["INNODB LOCKS", "INNODB LOCK WAITS", "INNODB TRX", "LOCK DETAILS", "Metadata locks"]
FACT_SECTIONS = [
    "hostname", "os kernal", "os kernel", "os release", "mem info", "CPU cores", "CPU model",
    "Top Info", "disk mount", "resource limit", "mysqld process limits",
    "MySQL Database Version", "MySQL Variables", "my.cnf detail", "MySQL Replication Info",
    "Engine innodb status", "innodb_tablespaces", "Slow query log status",
    "Slow query log tail", "Error log status", "Error log tail", "Backup tools available",
    "Crontab for mysql user", "Crontab for root", "System cron files for backup",
    "Backup directory inspection", "Binlog directory", "Datadir size", "Relay log directory",
    "Audit plugin status", "TLS / SSL configuration", "TLS / SSL status",
    "Password validation policy", "InnoDB encryption status", "Keyring plugin",
    "Global SQL_MODE",
]
ALL_SECTIONS = list(dict.fromkeys(FACT_SECTIONS + LOCK_SECTIONS + [s for s, _ in TABLE_SPECS.values()]))

EMPTY_TEXTS = "array<string>"


def section(name: str) -> Column:
    """A section's text; null when it was not collected."""
    return F.col("sections")[name]


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A regex group, or null where the pattern does not match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def lines(text: Column) -> Column:
    return F.coalesce(F.split(text, "\n"), F.array().cast(EMPTY_TEXTS))


def first_line(text: Column) -> Column:
    odd_start = F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*([^\n]*)", 1))
    head = F.ltrim(F.substring_index(text, "\n", 1), F.lit(" \t\x0b\f\r"))
    return F.when(head != "", F.trim(head)).otherwise(odd_start)


def _cell(name_options: tuple[str, ...], position: int) -> Column:
    lowered = F.transform("headers", F.lower)
    by_name = F.coalesce(*[F.nullif(F.array_position(lowered, n), F.lit(0)) for n in name_options])
    index = F.coalesce(by_name - 1, F.lit(position)).cast("int")
    return F.get("cells", index)


def typed_table(rows: DataFrame, name: str, keys: list[str] = KEYS) -> DataFrame:
    """One typed table from the boxed rows; reads only that section's rows."""
    section_name, columns = TABLE_SPECS[name]
    kept = rows.filter(F.lower("section").startswith(section_name.lower()) & F.col("is_valid"))

    def value(kind: str, cell: Column) -> Column:
        if kind == "string":
            return cell
        if kind == "double":
            return S.number_or_null(cell)
        return F.regexp_replace(cell, ",", "").try_cast(kind)

    table = kept.select(
        *keys, "row_no", *[value(kind, _cell(headers, pos)).alias(n) for n, pos, kind, headers in columns]
    )
    if name in SQL_TABLES:
        table = table.filter(~S.is_metadata_query("query", "db"))
    if name == "auto_increment":
        table = table.filter(F.col("rate") > 0.5)
    if name == "db_sizes":
        table = table.withColumn("is_total", F.col("name") == fv.DATABASE_TOTAL_LABEL)
    return table


def typed_tables(rows: DataFrame, keys: list[str] = KEYS) -> dict[str, DataFrame]:
    return {name: typed_table(rows, name, keys) for name in TABLE_SPECS}


def raw_section_rows(rows: DataFrame, section_name: str, keys: list[str] = KEYS) -> DataFrame:
    """Rows of a section as name -> cell maps, for tables whose columns vary by server version."""
    kept = rows.filter((F.lower("section") == section_name.lower()) & F.col("is_valid"))
    return kept.select(*keys, "row_no", F.map_from_arrays("headers", "cells").alias("cells"))


def _last_per_name(entries: Column) -> Column:
    """Keeps the last of the entries that share a name; entries are a dump's few dozen lines."""

    def is_last(all_entries: Column, e: Column, i: Column) -> Column:
        after = F.slice(all_entries, i + 2, F.size(all_entries))
        return ~F.exists(after, lambda later: later["name"] == e["name"])

    return ingest.let(entries, lambda all_entries: F.filter(all_entries, lambda e, i: is_last(all_entries, e, i)))


def _pairs(text: Column, pattern: str, name_group: int, value_group: int, value=lambda v: v) -> Column:
    matching = F.filter(lines(text), lambda line: line.rlike(pattern))
    return F.transform(
        matching,
        lambda line: F.struct(
            F.regexp_extract(line, pattern, name_group).alias("name"),
            value(F.regexp_extract(line, pattern, value_group)).alias("value"),
        ),
    )


VARIABLE_LINE = r"^\s*(@@global\.)?([A-Za-z_][A-Za-z0-9_]*)\s*:\s*(.+?)\s*$"


def variables_map(text: Column, cnf: Column) -> Column:
    """Variables by name. A configuration file overrides server_id and supplies log_bin if absent.

    The last entry of a name wins, so the override goes last and the supplement first.
    """
    shown = _pairs(text, VARIABLE_LINE, 2, 3, S.normalize_value)

    def configured(name: str, value: str) -> Column:
        entry = F.struct(F.lit(name).alias("name"), cnf_value(cnf, name, value).alias("value"))
        return F.filter(F.array(entry), lambda e: e["value"].isNotNull())

    entries = F.concat(configured("log_bin", r"\S+"), shown, configured("server_id", r"\d+"))
    return F.map_from_entries(_last_per_name(entries))


def cnf_value(text: Column, name: str, value: str) -> Column:
    """The last assignment of an option in a configuration file."""
    values = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?m)^\s*{name}\s*=\s*({value})"), 1)
    return F.try_element_at(values, F.lit(-1))


def status_map(text: Column) -> Column:
    pattern = r"^\s*(\w+):\s*(.*?)\s*$"
    return F.map_from_entries(_last_per_name(_pairs(text, pattern, 1, 2)))


def name_value_map(text: Column) -> Column:
    """A two-column boxed table as a map."""
    entries = F.transform(
        F.filter(ingest.boxed_data(text), lambda r: F.size(r) >= 2),
        lambda r: F.struct(F.get(r, F.lit(0)).alias("name"), F.get(r, F.lit(1)).alias("value")),
    )
    return F.map_from_entries(_last_per_name(entries))


def disks_array(text: Column) -> Column:
    """df rows as structs; a file system name wrapped onto its own line is joined to the next one."""
    kept = F.filter(lines(text), lambda line: (F.trim(line) != "") & ~line.startswith("Filesystem"))
    split_lines = F.transform(kept, lambda line: F.split(F.trim(line), r"\s+"))

    names = ["filesystem", "total", "used", "avail", "use_pct_text", "mount"]

    def alone(cols: Column) -> Column:
        return (F.size(cols) == 1) & F.get(cols, F.lit(0)).startswith("/")

    def complete(all_lines: Column, cols: Column, i: Column) -> Column:
        before = F.get(all_lines, i - 1)
        wrapped = (i > 0) & F.coalesce(alone(before), F.lit(False))
        return F.when(alone(cols), F.lit(None)).when(wrapped, F.concat(before, cols)).when(F.size(cols) >= 6, cols)

    def disk(cols: Column) -> Column:
        fields = [F.get(cols, F.lit(p)).alias(n) for p, n in enumerate(names)]
        pct = F.regexp_extract(F.get(cols, F.lit(4)), r"^(\d+)", 1).try_cast("bigint").alias("use_pct")
        return F.struct(*fields, pct)

    full = ingest.let(split_lines, lambda x: F.transform(x, lambda cols, i: complete(x, cols, i)))
    usable = F.filter(full, lambda cols: F.coalesce(F.get(cols, F.lit(1)).rlike(r"^\d"), F.lit(False)))
    return F.transform(usable, disk)


def slow_log_entry(piece: Column, names: list[str] | None = None) -> Column:
    """One slow-log entry: the text that follows a '# Time:' mark. names: the fields that are wanted, else all."""
    timing = r"(?m)^# Query_time:\s+[\d.]+\s+Lock_time:\s+[\d.]+\s+Rows_sent:\s+\d+\s+Rows_examined:\s+\d+"
    body = F.filter(
        F.split(piece, "\n"),
        lambda line, i: (i > 0)
        & ~(line.startswith("#") | line.startswith("use ") | line.startswith("SET timestamp=") | (F.trim(line) == "")),
    )
    joined = F.array_join(F.transform(body, lambda x: F.trim(x)), " ")
    dbs = F.regexp_extract_all(piece, F.lit(r"(?m)^use ([^\n;]*)"), 1)
    # A number follows each colon: time, lock time, rows sent, rows examined.
    odd = "\t\n\x0b\f\r"
    found_at = ingest.let(
        F.regexp_extract(piece, timing, 0),
        lambda t: F.when(reduce(Column.__or__, [F.contains(t, F.lit(c)) for c in odd]), F.translate(t, odd, " " * 5)).otherwise(t),
    )
    numbers = F.transform(F.split(found_at, ":"), lambda x: F.substring_index(F.trim(x), " ", 1))

    def entry(n: Column) -> Column:
        fields = {
            "time": first_line(piece),
            "user_host": F.trim(F.get(F.regexp_extract_all(piece, F.lit(r"(?m)^# User@Host:([^\n]*)$"), 1), F.lit(0))),
            "query_s": F.get(n, F.lit(1)).try_cast("double"),
            "lock_s": F.get(n, F.lit(2)).try_cast("double"),
            "rows_sent": F.get(n, F.lit(3)).try_cast("bigint"),
            "rows_examined": F.get(n, F.lit(4)).try_cast("bigint"),
            "db": F.trim(F.try_element_at(dbs, F.lit(-1))),
            "sql": ingest.let(joined, lambda text: F.when(text != "", text)),
        }
        return F.struct(*[value.alias(name) for name, value in fields.items() if names is None or name in names])

    return ingest.let(numbers, entry)


def _statements(piece: Column) -> Column:
    """A time mark's text as one piece per statement: servers before 5.7 print the mark once per second."""
    user = "# User@Host:"

    def each(parts: Column) -> Column:
        after = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
        mark = F.concat(first_line(piece), F.lit(f"\n{user}"))
        return F.when(F.size(parts) < 2, F.array(piece)).otherwise(
            ingest.let(mark, lambda m: F.transform(after, lambda p: F.concat(m, p)))
        )

    # Newer servers: a line with the time, then one statement. Such a text is a piece as it is.
    head = F.substring_index(piece, "\n", 1)
    single = (
        (F.trim(head, F.lit(" \t\x0b\f\r")) != "")
        & F.startswith(piece, F.concat(head, F.lit(f"\n{user}")))
        & (F.substring_index(piece, user, 2) == piece)
    )
    return F.when(single, F.array(piece)).otherwise(ingest.let(F.split(piece, rf"(?m)^{user}"), each))


def _entries(pieces: Column, names: list[str] | None = None) -> Column:
    """One row per statement of texts that follow a '# Time:' mark.

    Whole entries are exploded: a filter on what a generator gives stays above
    it, while one on a projection would parse each entry again per condition.
    """
    return F.explode_outer(F.transform(pieces, lambda p: slow_log_entry(p, names))).alias("e")


def _valid_entries(df: DataFrame) -> DataFrame:
    return df.filter(F.col("e.query_s").isNotNull() & F.col("e.sql").isNotNull())


def slow_log_entries(texts: DataFrame, keys: list[str] = KEYS, text: str = "text") -> DataFrame:
    """Entries of slow-log texts (dump tails), one row per statement."""
    body = F.regexp_replace(F.col(text), "\r\n", "\n")
    usable = (F.trim(body) != "") & ~body.rlike(fv.UNAVAILABLE_PATTERN)
    pieces = F.filter(F.split(body, r"(?m)^# Time:"), lambda p, i: i > 0)
    parsed = texts.filter(usable).select(*keys, _entries(F.flatten(F.transform(pieces, _statements))))
    return _valid_entries(parsed).select(*keys, "e.*")


def read_slow_logs(spark: SparkSession, path: str, snapshot_date: str) -> DataFrame:
    """Entries of full slow logs: (keys, file_name, entry). A record ends at the next '# Time:' line, so one log splits over tasks.

    The node is the last IPv4 address in the file's path, the cluster the
    folder above the part of the path that names it.
    """
    return slow_log_records(spark.read.format("text").options(**SLOW_LOG_OPTIONS).load(path), snapshot_date)


def keys_of_path(snapshot_date: str) -> list[Column]:
    """Keys of a full log. The node is the last IPv4 address in the file's path, the cluster the folder above the part that names it."""
    ip = ingest.IP_PATTERN
    node = F.nullif(F.regexp_extract("file_path", rf"^.*(?<![\d.]){ip}(?![\d.]*\d)", 1), F.lit(""))
    cluster = F.nullif(F.regexp_extract("file_path", rf"^(?:[^/]*/)*?([^/]+)/[^/]*?{ip}", 1), F.lit(""))
    return [F.coalesce(cluster, F.lit("unnamed")).alias("cluster_id"), F.lit(snapshot_date).cast("date").alias("snapshot_date"), node.alias("node_ip")]


# How slow logs are read, in one go or as a stream of files.
SLOW_LOG_OPTIONS = {"lineSep": "\n# Time:", "recursiveFileLookup": "true"}


def slow_log_records(texts: DataFrame, snapshot_date: str) -> DataFrame:
    """Entries of slow logs that were read by SLOW_LOG_OPTIONS, streaming or not."""
    entries = slow_log_file_records(texts)
    return entries.select(*keys_of_path(snapshot_date), *[c for c in entries.columns if c != "file_path"])


def slow_log_file_records(texts: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The same by file, (file_path, file_name, entry), for readers that find a file's node once and not per entry."""
    records = texts.select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("piece")
    )
    mark = "# Time:"

    def statements(p: Column) -> Column:
        return ingest.let(F.when(p.startswith(mark), F.substring(p, len(mark) + 1, 1 << 30)).otherwise(p), _statements)

    parsed = records.select("file_path", "file_name", _entries(ingest.let(F.replace("piece", F.lit("\r\n"), F.lit("\n")), statements), names))
    return _valid_entries(parsed).select("file_path", "file_name", "e.*")


def error_severity(line: Column) -> Column:
    note = line.rlike(r"(?i)\[Note\]")
    return (
        F.when(line.rlike(r"\[ERROR\]") | (line.rlike(r"\bERROR\b") & ~note), "error")
        .when(line.rlike(r"(?i)\[Warning\]") | (line.rlike(r"\bWarning\b") & ~note), "warning")
        .when(line.rlike(r"(?i)ready for connections|shutdown|starting|aborted|crash"), "lifecycle")
    )


def error_log_lines(texts: DataFrame, keys: list[str] = KEYS, text: str = "text") -> DataFrame:
    """Lines of error-log tails: (keys, line_no, line, severity); severity is null for other lines."""
    body = F.regexp_replace(F.col(text), "\r\n", "\n")
    usable = (F.trim(body) != "") & ~body.rlike(fv.UNAVAILABLE_PATTERN)
    exploded = texts.filter(usable).select(*keys, F.posexplode(F.split(body, "\n")).alias("line_no", "line"))
    return exploded.withColumn("severity", error_severity(F.col("line")))


def read_error_logs(spark: SparkSession, path: str, snapshot_date: str) -> DataFrame:
    """Lines of full error logs: (keys, file_name, line_no, line, severity), numbered from 0 in each file.

    A log of any size is read in as many splits as its bytes need. A line's
    number is its place in its split, plus the lines of the file's splits
    before: only those counts, one row a split, meet in a window, so the log
    itself is not shuffled. Both readings of a log see the same splits, as the
    splits follow from the files and the session's settings.
    """
    texts = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        F.regexp_replace("value", "\r$", "").alias("line"),
    )
    splits = texts.groupBy("file_path", "block").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = splits.select("file_path", "block", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("offset"))
    # One row a split: adaptive execution broadcasts it as long as it is small.
    numbered = texts.join(offsets, ["file_path", "block"])
    return numbered.select(
        *keys_of_path(snapshot_date),
        "file_name",
        (F.col("place") + F.col("offset")).cast("int").alias("line_no"),
        "line",
        error_severity(F.col("line")).alias("severity"),
    )


def backup_dirs_array(text: Column) -> Column:
    """Scanned directories; a line that reports a missing one ends the directory above it."""
    t = F.coalesce(text, F.lit(""))
    pieces = F.split(t, r"(?m)^=====\s+(?=.+\s+=====$)")
    file_line = r"(?m)^(\d{4}-\d{2}-\d{2}\+[\d:.]+\s+\d+\s+.+)$"
    file_parts = r"^(\S+)\s+(\d+)\s+(.+)$"

    def file(line: Column) -> Column:
        stamp = F.regexp_replace(F.regexp_extract(line, file_parts, 1), r"\..*$", "")
        return F.struct(
            F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd+HH:mm:ss")).alias("mtime"),
            F.regexp_extract(line, file_parts, 2).try_cast("bigint").alias("bytes"),
            F.regexp_extract(line, file_parts, 3).alias("path"),
        )

    def scanned(piece: Column) -> Column:
        own = F.get(F.split(piece, rf"(?m)^.*\[--\]\s+\S+\s+{fv.MISSING_LABEL}"), F.lit(0))
        size = found(own, rf"(?m)^{fv.TOTAL_SIZE_LABEL}:\s*(.+)$")
        return F.struct(
            F.regexp_extract(piece, r"^(.+?)\s+=====", 1).alias("path"),
            F.lit(True).alias("exists"),
            F.trim(size).alias("total_size"),
            F.transform(F.regexp_extract_all(own, F.lit(file_line), 1), file).alias("files"),
        )

    def missing(path: Column) -> Column:
        files = F.filter(F.array(file(F.lit(""))), lambda f: F.lit(False))
        return F.struct(
            path.alias("path"), F.lit(False).alias("exists"), F.lit(None).cast("string").alias("total_size"), files.alias("files")
        )

    dirs = F.transform(F.filter(pieces, lambda p, i: i > 0), scanned)
    absent = F.transform(F.regexp_extract_all(t, F.lit(rf"\[--\]\s+(\S+)\s+{fv.MISSING_LABEL}"), 1), missing)
    return F.concat(dirs, absent)


def backup_dirs(sections: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    dirs = sections.select(*keys, F.explode_outer(backup_dirs_array(section("Backup directory inspection"))).alias("d")).filter("d IS NOT NULL")
    return dirs.select(*keys, "d.path", "d.exists", "d.total_size", F.size("d.files").cast("bigint").alias("n_files"))


def backup_files(sections: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    dirs = sections.select(*keys, F.explode_outer(backup_dirs_array(section("Backup directory inspection"))).alias("d")).filter("d IS NOT NULL")
    files = dirs.select(*keys, F.col("d.path").alias("dir"), F.explode("d.files").alias("f"))
    return files.select(*keys, "dir", "f.path", "f.mtime", "f.bytes")


def backup_tools(sections: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    pattern = r"^\[(OK|--)\]\s+(\S+):\s*(.*)$"
    line = F.explode_outer(F.filter(lines(section("Backup tools available")), lambda x: x.rlike(pattern))).alias("line")
    return sections.select(*keys, line).filter("line IS NOT NULL").select(
        *keys,
        F.regexp_extract("line", pattern, 2).alias("tool"),
        (F.regexp_extract("line", pattern, 1) == "OK").alias("installed"),
        F.regexp_extract("line", pattern, 3).alias("detail"),
    )


def cron_lines(sections: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Cron text per source: (keys, source, line)."""
    sources = {
        "mysql": "Crontab for mysql user",
        "root": "Crontab for root",
        "system": "System cron files for backup",
    }
    rows = F.array(*[
        F.struct(F.lit(source).alias("source"), lines(section(name)).alias("lines"))
        for source, name in sources.items()
    ])
    return (
        sections.select(*keys, F.explode(rows).alias("r"))
        .select(*keys, "r.source", F.explode("r.lines").alias("line"))
        .filter(F.trim("line") != "")
    )


def active_trx_array(text: Column) -> Column:
    pattern = r"(?s)---TRANSACTION\s+(\d+),\s+(?!not started)([^\n]+)\n(.*?)(?=---TRANSACTION|\nTRANSACTIONS|\n--END)"
    blocks = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 0)
    head = r"(?s)^---TRANSACTION\s+(\d+),\s+([^\n]+)\n(.*)$"
    return F.transform(
        blocks,
        lambda b: F.struct(
            F.regexp_extract(b, head, 1).alias("trx_id"),
            F.trim(F.regexp_extract(b, head, 2)).alias("state"),
            F.regexp_replace(F.regexp_extract(b, head, 3), r"^\s+|\s+$", "").alias("detail"),
        ),
    )


def active_trx(sections: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    text = section("Engine innodb status")
    rows = sections.select(*keys, F.explode_outer(active_trx_array(text)).alias("t"))
    return rows.filter("t IS NOT NULL").select(*keys, "t.*")


def _temp_row(text: Column) -> tuple[Column, Column]:
    """Header and first data row of the temporary tablespace."""
    rows = F.filter(
        ingest.boxed_data(text), lambda r: F.lower(F.array_join(r, " ")).rlike("ibtmp|innodb_temporary")
    )
    return F.transform(F.get(ingest.boxed(text), F.lit(0)), F.upper), F.get(rows, F.lit(0))


def temp_tablespace(text: Column, config: Column) -> Column:
    """Struct of size, free bytes, initial size and auto-extend of the temporary tablespace."""
    headers, row = _temp_row(text)

    def value(name: str) -> Column:
        at = F.nullif(F.array_position(headers, name), F.lit(0))
        return S.number_or_null(F.get(row, (at - 1).cast("int")))

    size = F.coalesce(
        value("FILE_SIZE"),
        value("ALLOCATED_SIZE"),
        value("TOTAL_EXTENTS") * value("EXTENT_SIZE"),
        value("INITIAL_SIZE"),
        value("DATA_FREE"),
    )
    configured = F.coalesce(found(config, r"(?i)ibtmp1:([^:]+)(?::|$)"), F.lit("-"))
    extend = F.when(config.rlike("(?i)autoextend"), "autoextend").otherwise("-")
    initial, auto = value("INITIAL_SIZE"), value("AUTOEXTEND_SIZE")
    return F.when(
        row.isNotNull(),
        F.struct(
            size.cast("bigint").alias("size_bytes"),
            value("DATA_FREE").cast("bigint").alias("free_bytes"),
            F.when(initial.isNotNull(), S.fmt_bytes(initial)).otherwise(configured).alias("initial_size"),
            F.when(auto.isNotNull(), S.fmt_bytes(auto)).otherwise(extend).alias("auto_extend"),
            F.lit("text").alias("source"),
        ),
    )


def temp_tablespace_html(reports: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Temporary tablespace of legacy HTML reports: (keys, temp struct)."""
    row = F.regexp_extract(
        "content", r"(<tr>(?:[^<]*<td>[^<]*</td>)*[^<]*<td>[^<]*ibtmp1[^<]*</td>(?s:.*?)</tr>)", 1
    )
    cells = F.regexp_extract_all(row, F.lit(r"<td>([^<]*)</td>"), 1)

    def number(position: int) -> Column:
        return F.coalesce(F.get("cells", F.lit(position)).try_cast("bigint"), F.lit(0).cast("bigint"))

    extents = number(14) * number(15)
    return (
        reports.select(*keys, cells.alias("cells"))
        .filter(F.size("cells") >= 32)
        .select(
            *keys,
            F.struct(
                F.when(extents > 0, extents).otherwise(number(31)).alias("size_bytes"),
                number(31).alias("free_bytes"),
                S.fmt_bytes(number(16)).alias("initial_size"),
                S.fmt_bytes(number(18)).alias("auto_extend"),
                F.lit("html").alias("source"),
            ).alias("html_temp"),
        )
    )


def _size_after(text: Column, label: str) -> Column:
    return S.human_size_to_bytes(found(text, rf"{label}:\s*([\d.]+\s*[KMGT]?B?)"))


def _memory_columns(text: Column) -> dict[str, Column]:
    def kb(name: str) -> Column:
        return found(text, rf"(?m)^\s*{name}:\s+(\d+)").try_cast("bigint")

    total, swap_total, swap_free = kb("MemTotal"), kb("SwapTotal"), kb("SwapFree")
    zero = F.lit(0).cast("bigint")
    used = total - F.coalesce(kb("MemFree"), zero) - F.coalesce(kb("Buffers"), zero) - F.coalesce(kb("Cached"), zero)
    swap_used = F.greatest(zero, swap_total - swap_free)
    swap_used = F.when(swap_free.isNotNull(), swap_used)
    return {
        "mem_total_kb": total,
        "mem_free_kb": F.when(total.isNotNull(), F.coalesce(kb("MemFree"), zero)),
        "mem_used_kb": used,
        "mem_pct": F.round(F.try_divide(used * 100.0, total), 1),
        "swap_total_kb": swap_total,
        "swap_free_kb": swap_free,
        "swap_used_kb": swap_used,
        "swap_pct": F.when(
            swap_total.isNotNull(),
            F.coalesce(F.round(F.try_divide(swap_used * 100.0, swap_total), 1), F.lit(0.0)),
        ),
    }


def _host_columns() -> dict[str, Column]:
    release_lines = F.filter(
        F.transform(lines(section("os release")), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("cat: ")
    )
    release = F.coalesce(F.get(release_lines, F.lit(0)), F.lit(""))
    pretty = F.regexp_replace(F.regexp_extract(release, r"^PRETTY_NAME=(.+)$", 1), r"""^["']|["']$""", "")
    model = F.nullif(first_line(section("CPU model")), F.lit(""))
    top_model = F.trim(found(section("Top Info"), r"(?i)model name\s*:\s*(.+)"))
    kernel = F.coalesce(F.nullif(section("os kernal"), F.lit("")), section("os kernel"))
    cores = section("CPU cores")
    return {
        "hostname": first_line(section("hostname")),
        "os_kernel": first_line(kernel),
        "os_release": F.when(release.startswith("PRETTY_NAME="), pretty).otherwise(release),
        "cpu_cores": F.coalesce(found(cores, r"(?m)(\d+)\s*$"), found(cores, r"(\d+)")).try_cast("bigint"),
        "cpu_model": F.coalesce(model, top_model, F.lit("-")),
    }


def _server_columns() -> dict[str, Column]:
    text = section("MySQL Database Version")
    stats = (
        r"Threads:\s*(\d+)\s+Questions:\s*(\d+)\s+Slow queries:\s*(\d+)\s+Opens:\s*(\d+)"
        r"[^Q]*Queries per second avg:\s*([\d.]+)"
    )
    uptime = F.trim(found(text, r"(?m)Uptime:\s*(.+)$"))
    return {
        "server_version": F.coalesce(F.trim(found(text, r"Server version:\s*(.+)")), F.lit("-")),
        "uptime_text": F.coalesce(uptime, F.lit("-")),
        "uptime_sec": S.uptime_to_seconds(uptime),
        "threads_connected": found(text, stats, 1).try_cast("bigint"),
        "questions": found(text, stats, 2).try_cast("bigint"),
        "slow_queries": found(text, stats, 3).try_cast("bigint"),
        "qps": found(text, stats, 5).try_cast("double"),
    }


# Replica status fields.
REPLICATION_FIELDS = {
    "master_host": "Master_Host",
    "master_port": "Master_Port",
    "master_log_file": "Master_Log_File",
    "read_master_log_pos": "Read_Master_Log_Pos",
    "relay_master_log_file": "Relay_Master_Log_File",
    "io_running": "Slave_IO_Running",
    "sql_running": "Slave_SQL_Running",
    "last_io_error": "Last_IO_Error",
    "last_sql_error": "Last_SQL_Error",
    "master_uuid": "Master_UUID",
    "retrieved_gtid_set": "Retrieved_Gtid_Set",
    "executed_gtid_set": "Executed_Gtid_Set",
    "auto_position": "Auto_Position",
    "sql_running_state": "Slave_SQL_Running_State",
}


def _replication_columns() -> dict[str, Column]:
    text = section("MySQL Replication Info")
    status = F.col("repl_status")
    is_replica = F.coalesce(
        status["Slave_IO_State"].isNotNull() & status["Master_Server_Id"].rlike(r"^\d+"), F.lit(False)
    )
    header = F.get(ingest.boxed(text), F.lit(0))
    ips = F.trim(found(text, r"slave IP is\s*:\s*([\d.\s]+)"))
    columns = {
        "is_replica": is_replica,
        "replica_ips": F.filter(F.split(ips, r"\s+"), lambda x: x != ""),
        "connected_replicas": F.when(
            F.array_contains(header, "Slave_UUID"), F.size(ingest.boxed_data(text)).cast("bigint")
        ),
        "lag_seconds": F.when(is_replica, status["Seconds_Behind_Master"].try_cast("bigint")),
    }
    for name, field in REPLICATION_FIELDS.items():
        columns[name] = F.when(is_replica, status[field])
    return columns


# Engine status metrics.
ENGINE_PATTERNS = {
    "history_list": r"History list length\s+(\d+)",
    "log_sequence": r"Log sequence number\s+(\d+)",
    "log_flushed": r"Log flushed up to\s+(\d+)",
    "bp_pages": r"(?m)^Buffer pool size\s+(\d+)",
    "bp_free_pages": r"(?m)^Free buffers\s+(\d+)",
    "bp_data_pages": r"(?m)^Database pages\s+(\d+)",
    "bp_dirty_pages": r"(?m)^Modified db pages\s+(\d+)",
    "bp_hits": r"Buffer pool hit rate\s+(\d+)\s*/\s*\d+",
    "bp_lookups": r"Buffer pool hit rate\s+\d+\s*/\s*(\d+)",
    "pages_read": r"Pages read (\d+), created \d+, written \d+",
    "pages_created": r"Pages read \d+, created (\d+), written \d+",
    "pages_written": r"Pages read \d+, created \d+, written (\d+)",
}


def _engine_columns() -> dict[str, Column]:
    text = section("Engine innodb status")
    columns = {name: found(text, p).try_cast("decimal(20,0)") for name, p in ENGINE_PATTERNS.items()}
    columns = {
        n: (c if n in ("log_sequence", "log_flushed") else c.cast("bigint")) for n, c in columns.items()
    }
    deadlock = found(text, r"(?s)LATEST DETECTED DEADLOCK\s*\n[-=]+\s*\n(.*?)(?=\n[-=]{3,}\n|\z)")
    columns["latest_deadlock"] = F.regexp_replace(deadlock, r"^\s+|\s+$", "")
    columns["active_transactions"] = active_trx_array(text)
    return columns


def _storage_columns() -> dict[str, Column]:
    binlog, relay, data = section("Binlog directory"), section("Relay log directory"), section("Datadir size")
    any_size = S.human_size_to_bytes(found(data, r"([\d.]+\s*[KMGT]?B?)\s"))
    return {
        "slow_log_bytes": _size_after(section("Slow query log status"), "(?i)file size"),
        "error_log_bytes": _size_after(section("Error log status"), "(?i)file size"),
        "binlog_bytes": _size_after(binlog, fv.TOTAL_SIZE_LABEL),
        "binlog_dir": found(binlog, r"binlog dir:\s*(\S+)"),
        "data_bytes": F.coalesce(_size_after(data, fv.TOTAL_SIZE_LABEL), any_size),
        "data_dir": found(data, r"datadir:\s*(\S+)"),
        "relay_bytes": _size_after(relay, fv.TOTAL_SIZE_LABEL),
        "relay_dir": found(relay, r"relay log dir:\s*(\S+)"),
    }


def _security_columns() -> dict[str, Column]:
    """Evidence is null when its section was not collected, which is not the same as empty."""
    audit, policy = section("Audit plugin status"), section("Password validation policy")
    encryption, keyring = section("InnoDB encryption status"), section("Keyring plugin")
    tls = section("TLS / SSL configuration")
    empty_pw, old_auth = section("Users with empty password"), section("Users with old auth plugin")
    logins = section("failed login attempts")

    def filled(text: Column) -> Column:
        return F.nullif(text, F.lit(""))

    many_errors = F.exists(
        ingest.boxed_data(logins), lambda r: F.coalesce(F.get(r, F.lit(2)).try_cast("bigint") > 100, F.lit(False))
    )
    return {
        "has_audit": filled(audit).rlike("(?i)audit"),
        "tls_config": F.when(filled(tls).isNotNull(), name_value_map(tls)),
        "tls_state": F.when(
            filled(section("TLS / SSL status")).isNotNull(), name_value_map(section("TLS / SSL status"))
        ),
        "has_password_policy": policy.rlike("(?i)validate_password") & ~policy.rlike(fv.NOT_ENABLED_PATTERN),
        "has_encryption": ~encryption.rlike(fv.NOT_ENABLED_PATTERN) & (F.size(ingest.boxed_data(encryption)) > 0),
        "has_keyring": keyring.rlike("(?i)keyring"),
        "has_empty_password": F.when(empty_pw.isNotNull(), F.size(ingest.boxed_data(empty_pw)) > 0),
        "has_old_auth": F.when(filled(old_auth).isNotNull(), F.size(ingest.boxed_data(old_auth)) > 0),
        "has_login_failures": F.when(logins.isNotNull(), many_errors),
        "sql_mode": found(section("Global SQL_MODE"), r"\|\s*([A-Z_,]+)\s*\|"),
    }


def node_facts(sections: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row per dump with every scalar fact the health rules use."""
    carried = [c for c in sections.columns if c in ("file_name", "project") and c not in keys]
    cnf = section("my.cnf detail")
    base = sections.select(
        *keys,
        *carried,
        "sections",
        variables_map(section("MySQL Variables"), cnf).alias("variables"),
        status_map(section("MySQL Replication Info")).alias("repl_status"),
    )
    temp_config = F.col("variables")["innodb_temp_data_file_path"]
    temp_text = section("innodb_tablespaces")
    total = F.filter(
        ingest.boxed_data(section("DB TOTAL SIZE")), lambda r: F.get(r, F.lit(0)) == fv.DATABASE_TOTAL_LABEL
    )
    os_limit = found(section("resource limit"), r"(?i)open files\s+\([^)]+\)\s+(\d+)").try_cast("bigint")
    process_limit = found(section("mysqld process limits"), r"(?i)Max open files\s+(\d+)").try_cast("bigint")
    variable_limit = F.col("variables")["open_files_limit"].try_cast("bigint")
    errors = F.transform(lines(section("Error log tail")), error_severity)
    usable_log = section("Error log tail").isNotNull() & ~section("Error log tail").rlike(fv.UNAVAILABLE_PATTERN)

    def n_errors(kind: str) -> Column:
        matching = F.filter(errors, lambda s: F.coalesce(s == kind, F.lit(False)))
        return F.when(usable_log, F.size(matching).cast("bigint"))

    columns: dict[str, Column] = {
        **_host_columns(),
        **_memory_columns(section("mem info")),
        **_server_columns(),
        **_replication_columns(),
        **_engine_columns(),
        **_storage_columns(),
        **_security_columns(),
        "disks": disks_array(section("disk mount")),
        "temp": temp_tablespace(temp_text, F.coalesce(temp_config, F.lit(""))),
        "temp_collected": temp_text.isNotNull(),
        "db_total_gb": S.number_or_null(F.get(F.get(total, F.lit(0)), F.lit(1))),
        "open_files_limit": F.coalesce(
            F.nullif(process_limit, F.lit(0)), F.nullif(variable_limit, F.lit(0)), os_limit
        ),
        "locks_collected": F.exists(
            F.array(*[F.col("sections")[n].isNotNull() for n in LOCK_SECTIONS]), lambda x: x
        ),
        "error_count": n_errors("error"),
        "warning_count": n_errors("warning"),
    }
    return base.select(*keys, *carried, "variables", *[c.alias(n) for n, c in columns.items()])


def apply_html_temp(facts: DataFrame, html_temp: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The legacy HTML value replaces the text value where it exists."""
    return facts.join(html_temp, keys, "left").withColumn("temp", F.coalesce("html_temp", "temp")).drop("html_temp")


def variables(facts: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return facts.select(*keys, F.explode_outer("variables").alias("name", "value")).filter("name IS NOT NULL")


def disks(facts: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    rows = facts.select(*keys, F.posexplode_outer("disks").alias("mount_no", "d"))
    return rows.filter("d IS NOT NULL").select(*keys, "mount_no", "d.*")


def section_texts(sections: DataFrame, name: str, keys: list[str] = KEYS) -> DataFrame:
    """(keys, text) of one section."""
    return sections.select(*keys, section(name).alias("text")).filter(F.col("text").isNotNull())
