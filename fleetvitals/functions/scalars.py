"""Scalar functions as native Column expressions; each stays inside codegen, no Python UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetvitals.functions import fixed_values as fv
from fleetvitals.functions.once import made_once

GIB = 1073741824
MIB = 1048576


def column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def any_match(value: Column, patterns: list[str]) -> Column:
    return reduce(lambda left, right: left | right, [value.rlike(p) for p in patterns])


def first_case(cases: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """The value of the first true condition."""
    expr = F
    for condition, value in cases:
        expr = expr.when(condition, value)
    return expr if otherwise is None else expr.otherwise(otherwise)


def number_or_null(value: Column | str) -> Column:
    text = F.trim(column(value).cast("string"))
    blank = (text == "") | (F.upper(text) == "NULL") | (text == "-")
    number = F.regexp_replace(text, ",", "").try_cast("double")
    return F.when(~blank & ~F.isnan(number), number)


def normalize_value(value: Column | str) -> Column:
    """Decimal text without its trailing zeros; every other text unchanged."""
    text = F.trim(column(value))
    trimmed = F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")
    no_leading = F.regexp_replace(trimmed, r"^(-?)0+(?=\d)", "$1")
    return F.when(text.rlike(r"^-?\d+\.\d+$"), no_leading).otherwise(text)


def _with_unit(number: Column, pattern: str, unit: str) -> Column:
    return F.concat(F.format_string(pattern, number), F.lit(unit))


def fmt_bytes(value: Column | str) -> Column:
    n = column(value).cast("double")
    return first_case(
        [
            (n.isNull() | F.isnan(n), F.lit("-")),
            (n >= GIB, _with_unit(n / GIB, "%.2f", " GB")),
            (n >= MIB, _with_unit(n / MIB, "%.2f", " MB")),
            (n >= 1024, _with_unit(n / 1024, "%.2f", " KB")),
        ],
        F.concat(n.cast("bigint").cast("string"), F.lit(" B")),
    )


def fmt_bytes_short(value: Column | str) -> Column:
    n = column(value).cast("double")
    return first_case(
        [
            (n.isNull(), F.lit("-")),
            (n >= GIB, _with_unit(n / GIB, "%.1f", " GB")),
            (n >= MIB, _with_unit(n / MIB, "%.0f", " MB")),
            (n >= 1024, _with_unit(n / 1024, "%.0f", " KB")),
        ],
        F.concat(n.cast("bigint").cast("string"), F.lit(" B")),
    )


def fmt_kb(value: Column | str) -> Column:
    return fmt_bytes(column(value).cast("double") * 1024)


def format_mb(value: Column | str) -> Column:
    n = column(value).cast("double")
    return first_case(
        [(n.isNull(), F.lit("-")), (n >= 1024, _with_unit(n / 1024, "%.1f", " GB"))],
        F.concat(F.floor(n + 0.5).cast("string"), F.lit(" MB")),
    )


def fmt_seconds(value: Column | str, units: tuple[str, str, str] = (" 天", " 小时", " 分")) -> Column:
    s = column(value).cast("bigint")
    days = F.floor(s / 86400).cast("string")
    hours = F.floor((s % 86400) / 3600).cast("string")
    minutes = F.floor((s % 3600) / 60).cast("string")
    day, hour, minute = (F.lit(u) for u in units)
    tail = F.concat(minutes, minute)
    return first_case(
        [
            (s.isNull(), F.lit("-")),
            (s >= 86400, F.concat(days, day, F.lit(" "), hours, hour, F.lit(" "), tail)),
            (s % 86400 >= 3600, F.concat(hours, hour, F.lit(" "), tail)),
        ],
        tail,
    )


def uptime_short(
    value: Column | str, units: tuple[str, str, str, str] = (" 天", " 小时", " 分", " 秒")
) -> Column:
    s = column(value).cast("bigint")

    def scaled(divisor: int, unit: str) -> Column:
        return F.concat(F.floor(s / divisor).cast("string"), F.lit(unit))

    return first_case(
        [
            (s.isNull() | (s <= 0), F.lit("-")),
            (s >= 86400, scaled(86400, units[0])),
            (s >= 3600, scaled(3600, units[1])),
            (s >= 60, scaled(60, units[2])),
        ],
        scaled(1, units[3]),
    )


def uptime_to_seconds(value: Column | str) -> Column:
    text = F.lower(column(value))

    def part(pattern: str, seconds: int) -> Column:
        found = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
        return F.coalesce(found.try_cast("bigint"), F.lit(0)) * seconds

    total = (
        part(r"(\d+)\s*days?", 86400)
        + part(r"(\d+)\s*hours?", 3600)
        + part(r"(\d+)\s*min", 60)
        + part(r"(\d+)\s*sec", 1)
    )
    return F.nullif(total, F.lit(0).cast("bigint"))


def human_size_to_bytes(value: Column | str) -> Column:
    text = F.trim(column(value))
    number = F.regexp_extract(text, fv.SIZE_PATTERN, 1).try_cast("double")
    unit = F.upper(F.regexp_extract(text, fv.SIZE_PATTERN, 2))
    factor = first_case(
        [(unit == u, F.lit(float(1024**p))) for p, u in enumerate(["", "K", "M", "G", "T"])]
    )
    return F.floor(number * factor + 0.5).cast("bigint")


def size_to_mb(value: Column | str, key: str) -> Column:
    """Megabytes of a size parameter; plain numbers follow the unit in the parameter's name."""
    text = F.trim(column(value))
    number = F.regexp_extract(text, fv.SIZE_PATTERN, 1).try_cast("double")
    unit = F.upper(F.regexp_extract(text, fv.SIZE_PATTERN, 2))
    if key.endswith("_in_mb"):
        plain = number
    elif key.endswith("_in_kb"):
        plain = number / 1024
    else:
        plain = number / MIB
    return first_case(
        [
            (unit == "T", number * MIB),
            (unit == "G", number * 1024),
            (unit == "M", number),
            (unit == "K", number / 1024),
        ],
        plain,
    )


def recommend_buffer_pool_mb(mem_gb: Column | str) -> Column:
    m = column(mem_gb).cast("double")
    reserve = first_case([(m <= 4, F.lit(1.0)), (m <= 16, F.lit(2.0))], F.lit(4.0))
    share = F.greatest(F.lit(1.0), F.least(m * 0.6, m - reserve))
    return F.when(m > 0, F.floor(share * 1024 + 0.5).cast("bigint"))


@made_once
def sql_mode_set(value: Column | str) -> Column:
    parts = F.split(F.upper(F.coalesce(column(value), F.lit(""))), ",")
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""))


def is_version_80_plus(version: Column | str) -> Column:
    major = F.regexp_extract(column(version), r"^(\d+)\.\d+", 1).try_cast("int")
    return F.coalesce(major >= 8, F.lit(False))


def ip_sort_key(ip: Column | str) -> Column:
    octets = F.split(F.coalesce(column(ip), F.lit("")), r"\.")
    padded = F.transform(
        octets, lambda o: F.lpad(F.coalesce(o.try_cast("int"), F.lit(0)).cast("string"), 3, "0")
    )
    return F.array_join(padded, ".")


def canonical_role(value: Column | str) -> Column:
    text = F.lower(column(value))
    return first_case(
        [
            (text.rlike(fv.PRIMARY_HINT), F.lit("primary")),
            (text.rlike(fv.DR_HINT), F.lit("dr")),
            (text.rlike(fv.REPLICA_HINT), F.lit("slave")),
        ]
    )


@made_once
def is_dr(role: Column | str, hostname: Column | str, file_name: Column | str) -> Column:
    hint = F.concat_ws(
        " ", F.coalesce(column(hostname), F.lit("")), F.coalesce(column(file_name), F.lit(""))
    )
    return F.coalesce(column(role) == "dr", F.lit(False)) | hint.rlike(fv.DR_ANYWHERE_HINT)


@made_once
def is_metadata_query(sql: Column | str, db: Column | str) -> Column:
    q = F.trim(column(sql))
    no_db = F.coalesce(column(db), F.lit("NULL")).isin("NULL", "")
    return F.coalesce(
        any_match(q, [fv.METADATA_VERB, fv.METADATA_SCHEMA, fv.SESSION_VERB, fv.TRANSACTION_VERB])
        | (no_db & q.rlike(fv.METADATA_PROBE)),
        F.lit(False),
    )


@made_once
def is_temp_or_history_table(name: Column | str) -> Column:
    return F.coalesce(any_match(column(name), fv.TEMP_OR_HISTORY_PATTERNS), F.lit(False))


@made_once
def is_ghost_table(name: Column | str) -> Column:
    t = column(name)
    return F.coalesce(
        any_match(t, fv.GHOST_PATTERNS) | (t.rlike(fv.GHOST_UNDERSCORE) & (F.length(t) > 4)),
        F.lit(False),
    )


@made_once
def table_category(name: Column | str) -> Column:
    t = F.coalesce(column(name), F.lit(""))
    return first_case(
        [
            (t.rlike(fv.CATEGORY_TEMP), F.lit("temp")),
            (t.rlike(fv.CATEGORY_HISTORY), F.lit("history")),
            (t.startswith("_"), F.lit("temp")),
        ],
        F.lit("business"),
    )


def is_archive_table(name: Column | str) -> Column:
    return F.coalesce(column(name).rlike(fv.ARCHIVE_TABLE), F.lit(False))


def _wildcard(user: Column | str, outcomes: list[str]) -> Column:
    u = F.lower(F.coalesce(column(user), F.lit("")))
    admin, replication, backup, monitor, readonly, business = (F.lit(o) for o in outcomes)
    return first_case(
        [
            ((u == "root") | u.rlike(fv.ADMIN_ACCOUNT), admin),
            ((u == "repl") | u.rlike(fv.REPLICATION_ACCOUNT), replication),
            (u.rlike(fv.BACKUP_ACCOUNT), backup),
            (u.rlike(fv.MONITOR_ACCOUNT), monitor),
            (u.rlike(fv.READONLY_ACCOUNT), readonly),
        ],
        business,
    )


@made_once
def wildcard_level(user: Column | str) -> Column:
    return _wildcard(user, ["critical", "high", "high", "low", "low", "medium"])


def wildcard_reason(user: Column | str) -> Column:
    return _wildcard(
        user,
        [
            "administrator account",
            "replication account",
            "backup account",
            "monitoring account",
            "read-only account",
            "business account",
        ],
    )


def score_level(score: Column | str) -> Column:
    s = column(score)
    return first_case(
        [
            (s.isNull(), F.lit("-")),
            (s >= 85, F.lit("excellent")),
            (s >= 70, F.lit("good")),
            (s >= 55, F.lit("medium")),
            (s >= 40, F.lit("poor")),
        ],
        F.lit("critical"),
    )


def disk_band(pct: Column | str) -> Column:
    p = column(pct)
    return first_case(
        [(p >= 90, F.lit("urgent")), (p >= 80, F.lit("attention")), (p >= 70, F.lit("normal"))],
        F.lit("ample"),
    )


def upper_band(value: Column | str, high: float, middle: float) -> Column:
    """Three bands where larger is worse."""
    v = column(value)
    return first_case([(v >= high, F.lit("high")), (v >= middle, F.lit("middle"))], F.lit("low"))


def lower_band(value: Column | str, good: float, fair: float) -> Column:
    """Three bands where larger is better."""
    v = column(value)
    return F.when(
        v.isNotNull(),
        first_case([(v >= good, F.lit("good")), (v >= fair, F.lit("warn"))], F.lit("bad")),
    )


def _lifecycle(key: Column, rows: list[tuple], names: list[str]) -> Column:
    """The first lifecycle row whose pattern matches; the table is a handful of literals."""

    def value(row: tuple) -> Column:
        return F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(names, row[1:])])

    return first_case([(key.rlike(row[0]), value(row)) for row in rows])


@made_once
def os_lifecycle(release: Column | str) -> Column:
    """Struct of major, status, eol_date, priority; null without a release text."""
    text = F.nullif(column(release), F.lit(""))
    rows = [(p, major, "eol", eol, priority) for p, major, eol, priority in fv.OS_LIFECYCLE]
    names = ["major", "status", "eol_date", "priority"]
    unknown = F.struct(
        *[F.lit(v).cast("string").alias(n) for n, v in zip(names, [None, "unknown", None, "P3"])]
    )
    return F.when(text.isNotNull(), F.coalesce(_lifecycle(text, rows, names), unknown))


@made_once
def server_lifecycle(version: Column | str) -> Column:
    """Struct of major, status, eol_date, priority; null for unlisted versions."""
    number = F.nullif(F.regexp_extract(column(version), r"(\d+\.\d+\.\d+)", 1), F.lit(""))
    return _lifecycle(number, fv.SERVER_LIFECYCLE, ["major", "status", "eol_date", "priority"])


@made_once
def tls_weak(versions: Column | str) -> Column:
    return F.coalesce(column(versions).rlike(fv.TLS_WEAK), F.lit(False))


def tls_status(have_ssl: Column | str, versions: Column | str) -> Column:
    v = F.coalesce(column(versions), F.lit(""))
    on = F.coalesce(column(have_ssl) == "YES", F.lit(False))
    return F.when(on & ~v.rlike(fv.TLS_WEAK) & v.rlike(fv.TLS_STRONG), F.lit("PASS")).otherwise("WARN")


def truncate(value: Column | str, n: int) -> Column:
    s = column(value)
    return first_case(
        [
            (s.isNull() | (s == ""), F.lit("-")),
            (F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("…"))),
        ],
        s,
    )


def date_label(value: Column | str) -> Column:
    return F.coalesce(F.date_format(column(value), "yyyy年MM月dd日"), F.lit("-"))


def month_label(value: Column | str) -> Column:
    return F.coalesce(F.date_format(column(value), "yyyy年M月"), F.lit("-"))


def fragment_rate(
    rows: Column | str, data: Column | str, index: Column | str, free: Column | str
) -> Column:
    total = column(data) + column(index) + column(free)
    rate = F.round(F.try_divide(column(free), total), 2)
    return F.when(column(rows).isNull(), F.lit(0.0)).otherwise(rate)


def auto_increment_rate(
    next_value: Column | str, data_type: Column | str, column_type: Column | str
) -> Column:
    kind = F.lower(column(data_type))
    bits = first_case([(kind == t, F.lit(b)) for t, b in fv.INTEGER_BITS.items()])
    unsigned = F.lower(column(column_type)).like("% unsigned").cast("int")
    capacity = F.pow(F.lit(2.0), bits + unsigned) - 1
    return F.round(column(next_value).cast("double") / capacity, 4)


def login_ip(host: Column | str) -> Column:
    return F.substring_index(column(host), ":", 1)


def clean_path(path: Column | str) -> Column:
    """A path without trailing punctuation and slashes; null when nothing is left."""
    text = F.regexp_replace(F.trim(column(path)), r"""[)"'`;,\s]+$""", "")
    return F.nullif(F.regexp_replace(text, r"/+$", ""), F.lit(""))


def paths_in_text(text: Column | str) -> Column:
    """Paths named in free text; a backup script stands for its directory."""
    found = F.transform(
        F.regexp_extract_all(column(text), F.lit(r"(/[A-Za-z0-9._\-/]+)"), 1), clean_path
    )
    script = r"(?i)backup\.sh$"
    resolved = F.transform(
        found, lambda p: F.when(p.rlike(script), F.regexp_replace(p, r"/[^/]*$", "")).otherwise(p)
    )
    kept = F.filter(
        resolved, lambda p: p.isNotNull() & (p != "") & ~p.rlike(r"(?i)mysqlop\.py$")
    )
    return F.array_distinct(kept)


def outside_system_schemas(schema: Column | str) -> Column:
    return ~F.lower(column(schema)).isin(fv.SYSTEM_SCHEMAS)
