"""Dump texts that Spark writes from the views, in the collector's format.

A text never holds more than one node row or one fixed-width range of keys,
so no text grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetvitals import KEYS
from fleetvitals.functions import fixed_values as fv

CHUNK = 64


def text(value) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.coalesce(column.cast("string"), F.lit("NULL"))


def marker(number: int, name: str) -> str:
    return f"{fv.SECTION_MARKER}  [{number:02d}] {name}\n"


def banner(number: int) -> str:
    line = "|" + "+" * 40 + "|\n"
    return f"{line}|  [{number:02d}] module {number:02d} |\n{line}"


def lines(*parts) -> Column:
    """Concatenates literals and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else text(p) for p in parts])


def section(number: int, name: str, *parts) -> Column:
    return lines(marker(number, name), *parts, "\n")


def variable_lines(names: list[str]) -> Column:
    present = [
        F.when(F.col(f"v_{n}").isNotNull(), F.concat(F.lit(f"      {'@@global.' if i % 2 else ''}{n}: "), F.col(f"v_{n}"), F.lit(".000000" if n == "max_connections" else "")))
        for i, n in enumerate(names)
    ]
    return F.concat_ws("\n", F.lit("*** 1. row ***"), *present)


def box(headers: list[str], rows: Column) -> Column:
    """A boxed table around an array of row texts."""
    ruler = "+" + "+".join("---" for _ in headers) + "+"
    head = f"{ruler}\n| " + " | ".join(headers) + f" |\n{ruler}\n"
    return F.concat(F.lit(head), F.array_join(rows, "\n"), F.lit(f"\n{ruler}"))


def row(*cells) -> Column:
    parts: list = ["| "]
    for i, c in enumerate(cells):
        parts += [c if isinstance(c, Column) else F.col(c), " |" if i == len(cells) - 1 else " | "]
    return lines(*parts)


def chunked(df: DataFrame, key: str, entry: Column, size: int = CHUNK) -> DataFrame:
    """(keys, entries): the entries of each range of size keys, in key order."""
    chunk = F.floor(F.col(key) / size)
    address = F.concat_ws(".", F.lit("172"), *[(F.floor(F.col("chunk") / d) % 256).cast("string") for d in (65536, 256, 1)])
    grouped = df.select(chunk.alias("chunk"), F.struct(F.col(key).alias("key"), entry.alias("entry")).alias("e"))
    grouped = grouped.groupBy("chunk").agg(F.sort_array(F.collect_list("e")).alias("es"))
    return grouped.select(
        (F.col("chunk") % 25).alias("cluster_id"),
        F.lit("2024-01-31").cast("date").alias("snapshot_date"),
        address.alias("node_ip"),
        F.transform("es", lambda e: e["entry"]).alias("entries"),
    )


def node_dumps(v, *sections: Column) -> DataFrame:
    """One dump per node out of the given sections."""
    return v["nodes"].select(*KEYS, "k", "file_name", F.concat(F.lit(banner(1)), *sections, F.lit(banner(2))).alias("content"))


def chunk_dumps(chunks: DataFrame, number: int, name: str, body: Column) -> DataFrame:
    return chunks.select(*KEYS, F.concat(section(number, name, body), F.lit(banner(number))).alias("content"))
