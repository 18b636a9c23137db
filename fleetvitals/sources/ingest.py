"""Text dumps to sections, boxed rows and presence.

A dump is one row. Everything here is a narrow projection over that row, so
reading needs no shuffle and no per-section rescan of the files. Landing moves
each row once, to files of even size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from fleetvitals import KEYS
from fleetvitals.functions import fixed_values as fv

# A banner that a collector prints between modules, as a whole line.
BANNER_LINE = r"(?m)^\s*(\|\+{5,}\||\|\s+\[\d+\]\s+.+\|)\s*$\n?"

IP_PATTERN = r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"


def _files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    return (
        spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*.{suffix}")
        .select(
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_name").alias("file_name"),
            F.col("value").alias("content"),
        )
    )


def _any_case(suffix: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)


def read_dumps(spark: SparkSession, path: str, pattern: str = fv.DUMP_FILE_PATTERN) -> DataFrame:
    """Every node dump under a path: (file_path, file_name, content)."""
    dumps = _files(spark, path, _any_case("txt")).filter(F.col("file_name").rlike(pattern))
    if dumps.isEmpty():
        raise FileNotFoundError(f"no dump file matching {pattern} under {path}")
    return dumps


def read_html_reports(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path, _any_case("html"))


def file_name_facts(df: DataFrame, run_date: str, project: str | None = None) -> DataFrame:
    """Adds cluster_id, node_ip, snapshot_date and project, all read from the file's path."""
    name = F.col("file_name")
    dated = F.coalesce(
        F.nullif(F.regexp_extract(name, r"_(\d{8})\d{4}\.txt$", 1), F.lit("")),
        F.nullif(
            F.regexp_replace(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})\.html$", 1), "-", ""),
            F.lit(""),
        ),
    )
    named = F.nullif(F.regexp_extract(name, r"\d+\.\d+\.\d+\.\d+_([^_-]+)[_-]", 1), F.lit(""))
    fallback = F.lit("unnamed")
    folder = F.nullif(F.regexp_extract("file_path", r"([^/]+)/[^/]+$", 1), F.lit(""))
    return df.withColumns(
        {
            "node_ip": F.nullif(F.regexp_extract(name, IP_PATTERN, 1), F.lit("")),
            "snapshot_date": F.coalesce(
                F.try_to_date(dated, "yyyyMMdd"), F.lit(run_date).cast("date")
            ),
            "project": F.lit(project) if project else F.coalesce(named, fallback),
            "cluster_id": F.coalesce(folder, fallback),
        }
    ).filter(F.col("node_ip").isNotNull())


def list_dumps(spark: SparkSession, path: str, run_date: str) -> DataFrame:
    """Every node dump under a path, by name only: (file_path, file_name, modified, keys, project). No content is read."""
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*.{_any_case('txt')}")
        .load(path)
        .select(
            F.col("path").alias("file_path"),
            F.substring_index("path", "/", -1).alias("file_name"),
            F.col("modificationTime").alias("modified"),
        )
    )
    return file_name_facts(listing.filter(F.col("file_name").rlike(fv.DUMP_FILE_PATTERN)), run_date)


MANIFEST = (
    "file_path string, file_name string, modified timestamp, cluster_id string, snapshot_date date, node_ip string, "
    "is_landed boolean, load_id string"
)


def unseen_dumps(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that no earlier load has seen as they are now: (listing columns, is_landed).

    is_landed: the file is to be read, as the last one by name of its node and
    snapshot; not if an earlier load has landed a later one.
    """
    seen = manifest.select("file_path", "modified")
    fresh = listing.join(seen, ["file_path", "modified"], "left_anti")
    before = manifest.filter("is_landed").groupBy(*KEYS).agg(F.max("file_name").alias("landed_name"))
    last = fresh.groupBy(*KEYS).agg(F.max("file_name").alias("last_name"))
    marked = fresh.join(last, KEYS).join(before, KEYS, "left")
    newest = (F.col("file_name") == F.col("last_name")) & (
        F.col("landed_name").isNull() | (F.col("file_name") >= F.col("landed_name"))
    )
    return marked.select(*listing.columns, newest.alias("is_landed"))


def read_listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The contents of some listed dumps; other files under their folders are not opened."""
    return spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("content")
    )


def current(landed: DataFrame, manifest: DataFrame) -> DataFrame:
    """The rows of each node's last load; landed carries load_id."""
    loads = manifest.filter("is_landed").select(*KEYS, "load_id").distinct()
    latest = loads.groupBy(*KEYS).agg(F.max("load_id").alias("latest"))
    superseded = loads.join(latest, KEYS).filter(F.col("load_id") < F.col("latest")).select(*KEYS, "load_id")
    # Nodes that were landed again: few, and broadcast by adaptive execution as long as they are.
    return landed.join(superseded, [*KEYS, "load_id"], "left_anti").drop("load_id")


def drop_superseded(spark: SparkSession, dumps: DataFrame, path: str, run_date: str) -> DataFrame:
    """Keeps the last file per node and snapshot.

    The superseded names come from a listing that never reads file contents.
    They are normally few, and adaptive execution then broadcasts them, so the
    contents themselves are not shuffled.
    """
    listing = list_dumps(spark, path, run_date)
    latest = listing.groupBy(*KEYS).agg(
        F.max("file_name").alias("latest_name"), F.count(F.lit(1)).alias("n_files")
    )
    superseded = (
        listing.join(latest.filter("n_files > 1"), KEYS)
        .filter(F.col("file_name") < F.col("latest_name"))
        .select("file_path")
    )
    return dumps.join(superseded, "file_path", "left_anti")


def let(value: Column, body) -> Column:
    """Evaluates a value once and hands it to an expression that uses it many times.

    Inside a lambda a plain expression would be evaluated again per element.
    """
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def _plain_lines(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def blocks(content: Column) -> Column:
    """Array of (title, body) between section markers."""
    # From the first dash of a line on, as a marker begins with one; other lines are passed without a try per character.
    pattern = r"\n[^\n-]*+(?=-)[^\n]*?" + fv.SECTION_MARKER
    # The first piece is whatever precedes the first marker.
    after = F.filter(F.split(F.concat(F.lit("\n"), _plain_lines(content)), pattern), lambda p, i: i > 0)

    def block(piece: Column) -> Column:
        title = F.trim(F.substring_index(F.substring_index(piece, "\n", 1), fv.SECTION_MARKER, 1))
        line_end = F.instr(piece, "\n")
        return F.struct(
            F.regexp_replace(title, r"^\[\d+\]\s*", "").alias("title"),
            F.when(line_end > 0, F.substring(piece, line_end + 1, F.length(piece)))
            .otherwise(F.lit(""))
            .alias("body"),
            (line_end > 0).alias("has_body"),
        )

    return F.transform(after, block)


def with_blocks(dumps: DataFrame) -> DataFrame:
    return dumps.withColumn("blocks", blocks(F.col("content"))).drop("content")


def _is_banner(line: Column) -> Column:
    text = F.trim(line)
    return text.rlike(r"^\|\+{5,}\|$") | text.rlike(r"^\|\s+\[\d+\]\s+.+\|$")


def strip_banners(section_lines: DataFrame) -> DataFrame:
    """Drops the module banners a collector prints between sections."""
    return section_lines.filter(~_is_banner(F.col("line")))


def section_lines(dumps: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Long form of every section: (keys, section, block_no, line_no, line)."""
    per_block = with_blocks(dumps).select(*keys, F.posexplode_outer("blocks").alias("block_no", "b"))
    lines = F.when(F.col("b.has_body"), F.split(F.col("b.body"), "\n")).otherwise(
        F.array().cast("array<string>")
    )
    return per_block.filter("b IS NOT NULL").select(
        *keys,
        F.col("b.title").alias("section"),
        "block_no",
        F.posexplode(lines).alias("line_no", "line"),
    )


def section_text(blocks_col: Column, name: Column) -> Column:
    """Text, without banners, of the first run of adjacent sections whose title starts with a name, else null."""
    wanted = F.lower(name)
    hits = F.transform(blocks_col, lambda b: F.startswith(F.lower(b["title"]), wanted))

    def joined(run: Column) -> Column:
        with_body = F.filter(run, lambda b: b["has_body"])
        text = F.array_join(F.transform(with_body, lambda b: b["body"]), "\n")
        return F.regexp_replace(text, BANNER_LINE, "")

    def first_run(h: Column) -> Column:
        start = F.array_position(h, True).cast("int")
        stop = F.array_position(F.slice(h, F.greatest(start, F.lit(1)), F.size(h)), False).cast("int")
        length = F.when(stop > 0, stop - 1).otherwise(F.size(h))
        return F.when(start > 0, joined(F.slice(blocks_col, start, length)))

    return let(hits, first_run)


def with_sections(dumps: DataFrame, names: list[str]) -> DataFrame:
    """Adds sections: MAP<name, text>, holding only the sections that the dump has."""
    blocked = dumps if "blocks" in dumps.columns else with_blocks(dumps)
    wanted = F.array(*[F.lit(n) for n in names])
    found = F.transform(
        wanted,
        lambda n: F.struct(n.alias("name"), section_text(F.col("blocks"), n).alias("text")),
    )
    present = F.filter(found, lambda s: s["text"].isNotNull())
    return blocked.withColumn("sections", F.map_from_entries(present))


def section_fields(sections: DataFrame, names: list[str]) -> DataFrame:
    """The map of sections as a struct with a field per known section.

    A Parquet scan can read single fields of a struct, but not single keys of
    a map. Both are read by name, so parsers take either.
    """
    fields = [F.col("sections")[n].alias(n) for n in names]
    return sections.withColumn("sections", F.struct(*fields))


def other_sections(blocked: DataFrame, names: list[str], keys: list[str] = KEYS) -> DataFrame:
    """Sections that no parser knows: (keys, section, block_no, text), as they were collected."""
    rows = blocked.select(*keys, F.posexplode("blocks").alias("block_no", "b"))
    title = F.lower("b.title")
    known = F.exists(F.array(*[F.lit(n.lower()) for n in names]), lambda n: F.startswith(title, n))
    return rows.filter(~known).select(
        *keys, F.col("b.title").alias("section"), "block_no", F.regexp_replace("b.body", BANNER_LINE, "").alias("text")
    )


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def section_presence(sections: DataFrame, names: list[str], keys: list[str] = KEYS) -> DataFrame:
    """Whether each expected section was collected, collected empty, or not collected."""

    def row(name: str) -> Column:
        text = F.col("sections")[name]
        filled = F.filter(_lines(text), lambda line: F.trim(line) != "")
        n_rows = F.coalesce(F.size(filled), F.lit(0))
        status = (
            F.when(text.isNull(), "not_collected").when(n_rows == 0, "collected_empty").otherwise("collected")
        )
        return F.struct(
            F.lit(name).alias("section"), n_rows.cast("bigint").alias("n_rows"), status.alias("status")
        )

    rows = F.explode(F.array(*[row(n) for n in names])).alias("r")
    return sections.select(*keys, rows).select(
        *keys, "r.section", F.when(F.col("r.status") == "not_collected", 0).otherwise(F.col("r.n_rows")).cast("bigint").alias("n_rows"), "r.status"
    )


def boxed(text: Column) -> Column:
    """Array of cell arrays of a boxed table; the first one is the header."""
    piped = F.filter(_lines(text), lambda line: F.trim(line).startswith("|"))

    def cells(line: Column) -> Column:
        inner = F.regexp_replace(F.trim(line), r"^\||\|[^|]*$", "")
        return F.transform(F.split(inner, r"\|"), lambda x: F.trim(x))

    return F.transform(piped, cells)


def boxed_data(text: Column) -> Column:
    """The well-formed data rows of a boxed table, without its header."""
    return let(
        boxed(text),
        lambda rows: F.filter(rows, lambda r, i: (i > 0) & (F.size(r) == F.size(F.get(rows, F.lit(0))))),
    )


def _section_entries(sections: DataFrame) -> Column:
    """Array of (name, text) of the sections that a dump has, from the map or the struct."""
    kind = sections.schema["sections"].dataType
    if isinstance(kind, MapType):
        return F.map_entries("sections")
    fields = F.array(*[F.struct(F.lit(n).alias("key"), F.col("sections")[n].alias("value")) for n in kind.names])
    return F.filter(fields, lambda s: s["value"].isNotNull())


def boxed_rows(sections: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Data rows of every boxed table: (keys, section, row_no, headers, cells, is_valid).

    A row whose width differs from its header's (a cell that contains a pipe)
    is kept with is_valid = false for the quarantine.
    """
    tables = sections.select(*keys, F.explode(_section_entries(sections)).alias("s")).select(
        *keys, F.col("s.key").alias("section"), boxed(F.col("s.value")).alias("rows")
    )
    return tables.select(
        *keys,
        "section",
        F.get("rows", F.lit(0)).alias("headers"),
        F.posexplode(F.slice("rows", 2, F.greatest(F.size("rows"), F.lit(1)))).alias("row_no", "cells"),
    ).withColumn("is_valid", F.size("cells") == F.size("headers"))


def quarantine(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("is_valid"))


def write_by_snapshot(df: DataFrame, path: str, partition: list[str]) -> DataFrame:
    """Lands a table by snapshot and reads it back; only the snapshots that are written are replaced.

    Rows are rebalanced by measured size: adaptive execution gives a small
    partition one task and cuts a large one into as many as its bytes need, each
    of about spark.sql.adaptive.advisoryPartitionSizeInBytes. So neither does a
    hot snapshot wait for a fixed number of writers, nor does every task leave
    a file in every partition.
    """
    (
        df.hint("rebalance", *[F.col(c) for c in partition])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", 5_000_000)
        .partitionBy(*partition)
        .parquet(path)
    )
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_boxed_rows(rows: DataFrame, path: str) -> DataFrame:
    """Lands the boxed rows so that each typed table reads only its own partition."""
    return write_by_snapshot(rows, path, ["snapshot_date", "section"])
