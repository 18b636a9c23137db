"""Repeated passages of dumps, by relative Lempel-Ziv parsing against all earlier dumps.

Collectors of one version print the same long passages into every dump. A
passage is removed where an earlier dump (a smaller id) has it too.

The reference that dumps are parsed against is every dump, cut into phrases
whose ends follow from content alone: a window of `window` words belongs to the
smallest hash of the short word runs in it, and a phrase is a maximal run of
windows that belong to the same one. Equal passages therefore have equal
phrases inside, wherever they stand. Reference blocks are hash ranges of
phrases; each dump is factored against the block that can hold its phrase, so
no dump has to meet every other.

1. A phrase that an earlier dump has is a factor of it, taken as a whole.
2. Phrases at the ends of a passage differ, as what surrounds it does. Where
   another dump's phrase belongs to the same hash, windows are compared one by
   one: the check at factor boundaries.

The result is exact per window, up to collisions of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetvitals.llm.words import _BASE, _INVERSE, U64, Words, _powers, hash_words, mix, pieces, split_words

# Words in the runs whose smallest hash a window belongs to.
SEED_WORDS = 8


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sliding_minimum(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every run of `size` values, by doubling."""
    out, have = values, 1
    while have * 2 <= size:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(values) - size + 1], out[size - have :]) if have < size else out


class Phrases:
    """Windows of a run of texts, each with what it belongs to, and their phrases."""

    def __init__(self, words: Words, window: int):
        hashes = hash_words(words)
        n = len(hashes)
        self.window, self.bounds = window, words.bounds
        sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(hashes * _powers(_BASE, n)[:n], out=sums[1:])
        self.sums, self.inverse = sums, _powers(_INVERSE, max(n, 1))
        if n < window:
            self.at = self.seed = self.first = self.length = np.zeros(0, np.int64)
            self.owner = np.zeros(0, np.int64)
            return
        q = min(SEED_WORDS, window)
        grams = self._span(np.arange(n - q + 1), q)
        smallest = _sliding_minimum(grams, window - q + 1)
        owners = words.owners()
        at = np.flatnonzero(owners[: n - window + 1] == owners[window - 1 :])
        seed, owner = smallest[at], owners[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (seed[1:] != seed[:-1]) | (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        self.at, self.seed, self.owner = at[first], seed[first], owner[first]
        self.length = np.diff(np.concatenate((first, [len(at)])))

    def _span(self, at: np.ndarray, n) -> np.ndarray:
        return mix((self.sums[at + n] - self.sums[at]) * self.inverse[at] + np.asarray(n).astype(U64))

    def phrase_hashes(self) -> np.ndarray:
        return self._span(self.at, self.length + self.window - 1)

    def window_hashes(self, at: np.ndarray) -> np.ndarray:
        return self._span(at, self.window)


def _phrases(dumps: DataFrame, window: int) -> DataFrame:
    schema = "seed long, phrase long, dump long, row_key long, first int, n int"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "content"):
                found = Phrases(split_words(part.column(2)), window)
                take = pa.array(found.owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        _long(found.seed),
                        _long(found.phrase_hashes()) if len(found.at) else pa.array([], pa.int64()),
                        part.column(0).take(take),
                        part.column(1).take(take),
                        pa.array((found.at - found.bounds[found.owner]).astype(np.int32)),
                        pa.array(found.length.astype(np.int32)),
                    ],
                    names=["seed", "phrase", "dump", "row_key", "first", "n"],
                )

    return dumps.mapInArrow(work, schema)


def _windows(dumps: DataFrame, window: int) -> DataFrame:
    """Windows of the given ranges: (window, dump, row_key, first, known).

    Of equal windows that a task meets, those of a larger id are repeats for
    sure (known) and need not be told apart by others; they get a hash of their
    own so that a very common window does not gather in one place.
    """
    schema = "win long, dump long, row_key long, first int, known boolean"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, least = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            for part in pieces(batch, "content"):
                words = split_words(part.column(2))
                found = Phrases(words, window)
                ranges = part.column(3)
                owner = np.repeat(np.arange(len(ranges)), np.diff(ranges.offsets.to_numpy()))
                flat = ranges.flatten()
                first = flat.field("first").to_numpy(zero_copy_only=False).astype(np.int64)
                n = flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
                if not len(first):
                    continue
                rows = np.repeat(np.arange(len(first)), n)
                at = first[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
                owner = owner[rows]
                dump = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[owner]
                key = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)[owner]
                win = found.window_hashes(at + words.bounds[owner])
                order = np.lexsort((dump, win))
                win, dump, key, at = win[order], dump[order], key[order], at[order]
                head = np.ones(len(win), dtype=bool)
                head[1:] = win[1:] != win[:-1]
                lowest = dump[np.flatnonzero(head)][np.cumsum(head) - 1]
                if len(seen):
                    place = np.minimum(np.searchsorted(seen, win), len(seen) - 1)
                    lowest = np.where(seen[place] == win, np.minimum(lowest, least[place]), lowest)
                known = dump > lowest
                merged = np.concatenate((seen, win[head]))
                values = np.concatenate((least, lowest[head]))
                order = np.lexsort((values, merged))
                merged, values = merged[order], values[order]
                keep = np.ones(len(merged), dtype=bool)
                keep[1:] = merged[1:] != merged[:-1]
                seen, least = merged[keep], values[keep]
                win = np.where(known, mix(key.view(U64) + at.astype(U64)), win)
                yield pa.RecordBatch.from_arrays(
                    [_long(win), pa.array(dump), pa.array(key), pa.array(at.astype(np.int32)), pa.array(known)],
                    names=["win", "dump", "row_key", "first", "known"],
                )

    return dumps.mapInArrow(work, schema)


def repeated_ranges(source: DataFrame, window: int) -> DataFrame:
    """Ranges of windows that an earlier dump has: (row_key, ranges of (first, n) in windows)."""
    named = source.where(F.col("dump").isNotNull())
    # Never null; said here, joins add no conditions of their own that would make equal branches differ.
    phrases = _phrases(named, window).where("seed IS NOT NULL AND phrase IS NOT NULL")
    per_phrase = phrases.groupBy("seed", "phrase").agg(F.min("dump").alias("least"), F.max("dump").alias("most"))
    per_seed = per_phrase.where("least <= most").groupBy("seed").agg(F.min("least").alias("l"), F.max("most").alias("m")).where("l < m").select("seed")
    # The condition always holds; it makes both uses of per_phrase read the same columns, and so the same shuffle.
    shared = per_phrase.where("least <= most").join(per_seed, "seed").select("seed", "phrase", "least")
    shared = phrases.join(shared, ["seed", "phrase"]).select("row_key", "first", "n", (F.col("dump") > F.col("least")).alias("factor"))
    edges = shared.where(~F.col("factor")).groupBy("row_key").agg(F.collect_set(F.struct("first", "n")).alias("ranges"))
    # From all of source, as the join that removes words: both then read one shuffle of the contents.
    open_ = source.join(edges, "row_key").select("dump", "row_key", "content", "ranges")
    same = Window.partitionBy("win")
    compared = (
        _windows(open_, window)
        .withColumn("least", F.min("dump").over(same))
        .where(F.col("known") | (F.col("dump") > F.col("least")))
        .select("row_key", "first", F.lit(1).alias("n"))
    )
    return (
        shared.where("factor").select("row_key", "first", "n").unionByName(compared)
        .groupBy("row_key")
        .agg(F.collect_set(F.struct("first", "n")).alias("ranges"))
    )


def remove_passages(dumps: DataFrame, window: int = 50, dump_id: str = "dump_id", content: str = "content") -> DataFrame:
    """Per row: dump_id, n_words, n_removed, kept_text, spans.

    A word is removed if it lies in a window of `window` consecutive words
    that also starts in a dump of smaller id. kept_text: the other words,
    joined by one space; spans: removed ranges of word numbers, end exclusive.
    Windows are judged on the input, not on what is left.

    Null content has no words. A dump without an id neither removes nor loses
    words. Rows of equal id do not remove each other's words; each has a row.
    Repeats inside one dump stay. An empty table gives an empty table.
    """
    source = dumps.select(
        F.col(dump_id).cast("long").alias("dump"),
        F.xxhash64(F.col(dump_id), F.col(content)).alias("row_key"),
        F.coalesce(F.col(content), F.lit("")).alias("content"),
    )
    ranges = repeated_ranges(source, window)
    schema = "dump long, n_words long, n_removed long, kept_text string, spans array<array<int>>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "content"):
                words = split_words(part.column(1))
                raw = words.data.tobytes()
                rows = []
                for i, (text, found) in enumerate(zip(part.column(1), part.column(2), strict=True)):
                    low, high = words.bounds[i], words.bounds[i + 1]
                    n = int(high - low)
                    mark = np.zeros(n + 1, dtype=np.int64)
                    if found.is_valid:
                        first = found.values.field("first").to_numpy(zero_copy_only=False)
                        length = found.values.field("n").to_numpy(zero_copy_only=False)
                        np.add.at(mark, first, 1)
                        np.add.at(mark, first + length + window - 1, -1)
                    gone = np.cumsum(mark)[:n] > 0
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                    if len(edge):
                        kept = np.flatnonzero(~gone) + low
                        text = b" ".join(raw[a:b] for a, b in zip(words.starts[kept].tolist(), words.ends[kept].tolist(), strict=True))
                    else:
                        text = b" ".join(text.as_buffer().to_pybytes().split())  # parts words at the same six bytes
                    rows.append((n, int(gone.sum()), text, edge.reshape(-1, 2).tolist()))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(columns[0], pa.int64()),
                        pa.array(columns[1], pa.int64()),
                        pa.array(columns[2], pa.binary()).cast(pa.string()),
                        pa.array(columns[3], pa.list_(pa.list_(pa.int32()))),
                    ],
                    names=["dump", "n_words", "n_removed", "kept_text", "spans"],
                )

    return (
        source.join(ranges, "row_key", "left")
        .select("dump", "content", "ranges")
        .mapInArrow(work, schema)
        .withColumnRenamed("dump", dump_id)
    )

