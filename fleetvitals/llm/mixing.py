"""Mixing clusters' dumps to target weights, block by block.

Words of a cluster's dumps, one dump after the other, are packed into blocks of
a fixed number of words. The mix is a row of output shards, each of a fixed
number of slots. How many slots of a shard a cluster gets is a multinomial draw
whose totals over all shards are held to the cluster's target, so the mix hits
its weights whatever the seed. A cluster's slots are numbered through all
shards; slot numbers go through a pseudorandom permutation of the cluster's
block numbers, a new one for each time around, and blocks are joined by number.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetvitals.llm.storage import stored
from fleetvitals.llm.words import U64, mix

# Dumps are numbered inside ranges of their hash; a range holds about this many dumps of a cluster.
ROWS_PER_RANGE = 5_000


def targets(sizes: dict, weights: Sequence[float], share: float, most: float) -> dict:
    """Words wanted per source.

    share times all words are dealt by weight; sources in code-point order,
    null last, take the weights in turn. No target exceeds `most` times its
    source's size: the excess is dealt again by weight until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    wanted, open_, left = {}, list(order), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not full:
            return wanted | {s: left * weight[s] / total for s in open_}
        for s in full:
            wanted[s] = float(most * sizes[s])
        left -= sum(wanted[s] for s in full)
        open_ = [s for s in open_ if s not in wanted]
    return wanted


def shard_counts(slots: np.ndarray, shards: int, size: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots before the shard, slots in it) per source.

    Multinomial draws per shard, given the totals: the shards are halved again
    and again, and each half's counts are drawn without replacement from what
    its parent has. A shard is found in log2(shards) draws, by any task alone.
    """
    before, here = np.zeros_like(slots), slots.copy()
    low, high = 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        left = _draw(here, min((middle - low) * size, int(here.sum())), np.random.default_rng([seed, low, high]))
        if shard < middle:
            here, high = left, middle
        else:
            before, here, low = before + left, here - left, middle
    return before, here


def _draw(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """n drawn without replacement; a normal draw where the urn is too large for the exact one."""
    out, rest = np.zeros_like(counts), int(counts.sum())
    for i, c in enumerate(counts):
        rest -= int(c)
        low, high = max(0, n - rest), min(int(c), n)
        if low == high:
            k = low
        elif c + rest < 1_000_000_000:
            k = int(rng.hypergeometric(int(c), rest, n))
        else:
            p = c / (c + rest)
            sd = (n * p * (1 - p) * (c + rest - n) / max(1, c + rest - 1)) ** 0.5
            k = min(high, max(low, round(rng.normal(n * p, sd))))
        out[i] = k
        n -= k
    return out


def permuted(index: np.ndarray, n: np.ndarray | int, key: np.ndarray | int) -> np.ndarray:
    """A bijection of 0..n-1 per key: four Feistel rounds, walked until the value is below n."""
    n = np.broadcast_to(np.asarray(n, dtype=U64), index.shape).astype(U64)
    key = np.broadcast_to(np.asarray(key, dtype=U64), index.shape)
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2).astype(np.float64)) / 2)).astype(U64)
    mask = (U64(1) << bits) - U64(1)
    out = index.astype(U64)
    todo = np.arange(len(out))
    while len(todo):
        right, left = out[todo] & mask[todo], out[todo] >> bits[todo]
        for r in range(4):
            left, right = right, left ^ (mix(right + key[todo] * U64(4) + U64(r + 1)) & mask[todo])
        out[todo] = (left << bits[todo]) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def mix_sources(
    dumps: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = 128,
    shard_slots: int = 4096,
    seed: int = 7,
    dump_id: str = "dump_id",
    source: str = "cluster_id",
    content: str = "content",
) -> DataFrame:
    """Per row: dump_id, size, source_size, target, taken, and row_hash.

    size: words of the content; source_size and target: its cluster's words,
    and the words that the mix should have of it; taken: words the mix takes
    from this dump, repeats counted, at most `most` (2 or less per time around)
    times its size. row_hash tells rows of equal id apart by content.

    Null content has no words; rows without words take part with 0. Dumps
    without a cluster make one source, ordered last. Rows of equal id and
    content lie next to each other and are taken as any others; each has a row.
    The same rows give the same mix, whatever their order and partitions.
    An empty table gives none. The table of sources (not of dumps) passes
    through the driver: one number per cluster.
    """
    row_hash = F.xxhash64(F.col(dump_id), F.col(source), F.col(content))
    sized = stored(
        dumps.select(
            F.col(dump_id).alias("dump_id"),
            F.col(source).alias("source"),
            F.regexp_count(F.coalesce(F.col(content), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
            row_hash.alias("row_hash"),
        ),
        "sizes",
    )
    per_source = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("dumps")).collect()
    sizes = {r.source: r.words for r in per_source}
    wanted = targets(sizes, weights, share, most)
    return _take(sized, per_source, wanted, block_words, shard_slots, seed, dump_id)


def _take(sized: DataFrame, per_source, wanted: dict, block_words: int, shard_slots: int, seed: int, dump_id: str) -> DataFrame:
    spark = sized.sparkSession
    order = sorted((r for r in per_source), key=lambda r: (r.source is None, r.source or ""))
    blocks = np.array([-(-r.words // block_words) for r in order], dtype=np.int64)
    mean = np.array([r.words / b if b else 1.0 for r, b in zip(order, blocks, strict=True)])
    slots = np.array([round(wanted.get(r.source, 0.0) / m) if b else 0 for r, m, b in zip(order, mean, blocks, strict=True)], dtype=np.int64)
    slots = np.minimum(slots, 2 * blocks)
    info = spark.createDataFrame(
        [
            (i, r.source, r.words, float(wanted.get(r.source, 0.0)), max(1, -(-r.dumps // ROWS_PER_RANGE)))
            for i, r in enumerate(order)
        ],
        "source_no int, source string, source_size long, target double, ranges long",
    )
    rows = sized.join(info, sized["source"].eqNullSafe(info["source"])).select(
        "source_no",
        "dump_id",
        "row_hash",
        "size",
        "source_size",
        "target",
        # Ranges of the row hash, so that a hot cluster is numbered by many tasks.
        F.least(
            F.floor((F.shiftrightunsigned("row_hash", 1) / F.lit(float(1 << 63))) * F.col("ranges")), F.col("ranges") - 1
        ).alias("range"),
    )
    totals = rows.groupBy("source_no", "range").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source_no").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("source_no", "range", F.coalesce(F.sum("words").over(running), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source_no", "range").orderBy("row_hash", "dump_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(totals, ["source_no", "range"])
        .withColumn("first", F.col("base") + F.col("before"))
    )
    shards = max(1, -(-int(slots.sum()) // shard_slots))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                before, here = shard_counts(slots, shards, shard_slots, int(shard), seed)
                number = np.repeat(np.arange(len(here)), here)
                at = np.arange(len(number)) - np.repeat(np.cumsum(here) - here, here) + before[number]
                n = np.maximum(blocks[number], 1)
                key = number.astype(U64) * U64(1 << 20) + (at // n).astype(U64) + U64(seed) * U64(1 << 40)
                drawn = [pa.array(number.astype(np.int32)), pa.array(permuted(at % n, n, key))]
                yield pa.RecordBatch.from_arrays(drawn, names=["source_no", "block"])

    taken_blocks = (
        spark.range(shards).repartition(min(shards, 2000))
        .mapInArrow(draw, "source_no int, block long")
        .groupBy("source_no", "block")
        .agg(F.count("*").alias("times"))
        # Planned from the few rows that name the shards, it would be broadcast; it grows with the mix.
        .hint("merge")
    )
    spread = placed.where("size > 0").select(
        "source_no", "dump_id", "row_hash", "first", "size",
        F.explode(F.sequence(F.floor(F.col("first") / block_words), F.floor((F.col("first") + F.col("size") - 1) / block_words))).alias("block"),
    )
    overlap = F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * block_words) - F.greatest(
        F.col("first"), F.col("block") * block_words
    )
    taken = (
        spread.join(taken_blocks, ["source_no", "block"])
        .groupBy("source_no", "first", "dump_id")
        .agg(F.sum(overlap * F.col("times")).alias("taken"))
        .select(F.col("source_no").alias("s"), F.col("first").alias("f"), F.col("dump_id").alias("d"), "taken")
    )
    joined = placed.join(
        taken,
        (F.col("source_no") == F.col("s")) & (F.col("first") == F.col("f")) & F.col("dump_id").eqNullSafe(F.col("d"))
        & (F.col("size") > 0),
        "left",
    )
    return joined.select(
        F.col("dump_id").alias(dump_id),
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).alias("taken"),
        "row_hash",
    )
