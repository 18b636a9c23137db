"""Quality of dumps: a document classifier within a hierarchy of sites.

Evidence on a dump comes from its words and shape (a sparse logistic model).
Dumps lie in a cluster (site) and, below it, a node or section (path). How good
a site and a path are is the mean of their dumps' evidence, shrunk: a path with
few dumps towards its site, a site with few towards all. How strongly follows
from how much sites, and paths within sites, differ (empirical Bayes, by
moments). A dump's odds are its evidence times the odds of its path over the
odds of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from fleetvitals.llm.storage import stored
from fleetvitals.llm.words import U64, binary_of, hash_words, lower_ascii, split_words

# The classifier is fitted on this many labelled dumps at most, those of the smallest id hash.
MAX_LABELLED = 10_000
BITS = 18
SCREEN = 4.0  # standard deviations
SHAPES = 7
COUNTED = 500  # dumps at a time


@dataclass(frozen=True)
class Model:
    """Logistic weights: per hashed word, per shape feature, and the offset."""

    words: np.ndarray
    shapes: np.ndarray
    offset: float


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, word slots, shapes): each text's distinct words as slots, and its shape features."""
    words = split_words(texts)
    n, counts = len(texts), words.counts
    lowered = type(words)(lower_ascii(words.data), words.starts, words.ends, words.bounds)
    slots = (hash_words(lowered) >> U64(64 - BITS)).astype(np.int64)
    owners = words.owners()
    key = np.unique(owners * (1 << BITS) + slots)
    bounds = np.searchsorted(key, np.arange(n + 1) * (1 << BITS))
    some = np.maximum(counts, 1)

    def per_word(values: np.ndarray) -> np.ndarray:
        return np.bincount(owners, weights=values, minlength=n) / some

    def per_byte(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags)))
        return sums

    lengths = words.ends - words.starts
    upper = per_byte((words.data >= 65) & (words.data <= 90))
    symbol = per_byte(np.isin(words.data, np.frombuffer(b"!#$%&*<>=|{}[]\\^~@_/+", dtype=np.uint8)))
    repeated = np.zeros(len(slots))
    if len(slots) > 1:
        repeated[1:] = (slots[1:] == slots[:-1]) & (owners[1:] == owners[:-1])
    shapes = np.stack(
        [
            np.log1p(counts) / 10,
            per_word(lengths) / 10,
            per_word((upper[words.ends] - upper[words.starts]) / lengths),
            per_word((symbol[words.ends] - symbol[words.starts]) / lengths),
            per_word(repeated),
            np.diff(bounds) / some,
            (counts == 0).astype(float),
        ],
        axis=1,
    )
    return bounds, key % (1 << BITS), shapes


def margins(model: Model, texts: pa.Array) -> np.ndarray:
    """Log odds of being good, per text."""
    out = np.empty(len(texts))
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size < (1 << 20)):
            size += len(texts[stop].as_buffer() or b"") if texts[stop].is_valid else 0
            stop += 1
        bounds, slots, shapes = encode(texts.slice(start, stop - start))
        sums = np.concatenate(([0.0], np.cumsum(model.words[slots])))
        out[start:stop] = sums[bounds[1:]] - sums[bounds[:-1]] + shapes @ model.shapes + model.offset
        start = stop
    return out


def fit(bounds: np.ndarray, slots: np.ndarray, shapes: np.ndarray, good: np.ndarray, epochs: int = 25, l1: float = 1e-4) -> Model:
    """Sparse logistic regression by proximal steps with one step size per weight."""
    n = len(good)
    words, dense, offset = np.zeros(1 << BITS), np.zeros(SHAPES), 0.0
    if n == 0:
        return Model(words, dense, offset)
    if good.all() or not good.any():
        return Model(words, dense, float(np.log((good.sum() + 1) / (n - good.sum() + 1))))
    # Only words that bad dumps have more, or less, often than chance would give them take part.
    held, bad = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS)
    for first in range(0, n, COUNTED):  # so what is counted with stays small beside the sample
        ends = bounds[first : first + COUNTED + 1]
        s = slots[ends[0] : ends[-1]]
        held += np.bincount(s, minlength=1 << BITS)
        bad += np.bincount(s, weights=np.repeat(1 - good[first : first + COUNTED], np.diff(ends)), minlength=1 << BITS)
    bad_share = 1 - good.mean()
    excess = bad - held * bad_share
    telling = (held >= 3) & (np.abs(excess) >= SCREEN * np.sqrt(np.maximum(held, 1) * bad_share * (1 - bad_share)))
    g2_words, g2_dense, g2_offset = np.full(1 << BITS, 1e-2), np.full(SHAPES, 1e-2), 1e-2
    rng = np.random.default_rng(0)
    centred = shapes
    # Few dumps make few steps a round; they get as many steps as it takes to settle.
    for _ in range(max(epochs, 1500 * 32 // n)):
        order = rng.permutation(n)
        for first in range(0, n, 32):
            rows = order[first : first + 32]
            take = np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in rows]) if len(rows) else np.zeros(0, int)
            owner = np.repeat(np.arange(len(rows)), bounds[rows + 1] - bounds[rows])
            s = slots[take]
            z = np.bincount(owner, weights=words[s], minlength=len(rows)) + centred[rows] @ dense + offset
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - good[rows]
            used, place = np.unique(s, return_inverse=True)
            gradient = np.bincount(place, weights=error[owner], minlength=len(used)) / len(rows)
            gradient[~telling[used]] = 0
            g2_words[used] += gradient**2
            rate = 0.3 / np.sqrt(g2_words[used])
            stepped = words[used] - rate * gradient
            words[used] = np.sign(stepped) * np.maximum(np.abs(stepped) - rate * l1, 0)
            gradient = centred[rows].T @ error / len(rows)
            g2_dense += gradient**2
            dense -= 0.3 / np.sqrt(g2_dense) * gradient
            g2_offset += error.mean() ** 2
            offset -= 0.3 / np.sqrt(g2_offset) * error.mean()
    return Model(words, dense, offset)


def train(
    dumps: DataFrame, labels: DataFrame, dump_id: str = "dump_id", content: str = "content", good: str = "good", max_labelled: int = MAX_LABELLED
) -> Model:
    """Fits on labelled dumps: (dump_id, good), good being 0 or 1. Labels without an id or a value are left out.

    Of rows that share an id one is taken, that of the smallest content hash.
    """
    wanted = (
        labels.select(F.col(dump_id).alias("id"), F.col(good).cast("int").alias("good"))
        .where(F.col("id").isNotNull() & F.col("good").isNotNull())
        .groupBy("id")
        .agg(F.max("good").alias("good"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_labelled)
    )
    # max_labelled rows of two numbers bound the broadcast.
    rows = dumps.select(F.col(dump_id).alias("id"), F.col(content).alias("text")).join(F.broadcast(wanted), "id")
    schema = "id long, good int, hash long, slots binary, shapes binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                _, slots, shapes = encode(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), pa.array([slots.astype(np.int32).tobytes()]), pa.array([shapes.tobytes()])],
                    names=["id", "good", "hash", "slots", "shapes"],
                )

    encoded = rows.select("id", "text", "good", F.xxhash64("text").alias("hash")).mapInArrow(work, schema)
    # One row per id, combined per task, so that repeated rows reach neither the driver nor the fit.
    once = encoded.groupBy("id").agg(F.min_by(F.struct("good", "slots", "shapes"), "hash").alias("r")).select("id", "r.*")
    # As Arrow, the sample passes the driver in its own size: its JVM makes no rows of it, and the columns' buffers are the arrays.
    got = once.toArrow().sort_by("id")
    slots, bounds = _numbers(got.column("slots"), np.int32)
    shapes, _ = _numbers(got.column("shapes"), np.float64)
    model = fit(bounds, slots, shapes.reshape(len(got), SHAPES), got.column("good").to_numpy().astype(float))
    del got, slots, shapes
    pa.default_memory_pool().release_unused()
    return model


def _numbers(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, bounds): what the bytes of a column hold, one array for all rows, and each row's range in it."""
    data, offsets = binary_of(column)
    bounds = (offsets - offsets[0]) // np.dtype(kind).itemsize if len(offsets) else np.zeros(1, np.int64)
    return (data[offsets[0] : offsets[-1]] if len(offsets) else data).view(kind), bounds


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(p / (1 - p))


def _strength(mean: str, parent: Column, n: str) -> Column:
    """How many dumps the parent's mean is worth: p(1-p) / variance between, minus one; within [1, 10000]."""
    between = F.sum(F.col(n) * (F.col(mean) - parent) ** 2) / F.sum(n) - F.sum(parent * (1 - parent)) / F.sum(n)
    within = F.sum(F.col(n) * parent * (1 - parent)) / F.sum(n)
    return F.least(F.greatest(within / F.greatest(between, F.lit(1e-9)) - 1, F.lit(1.0)), F.lit(10_000.0))


def classify(
    dumps: DataFrame,
    model: Model,
    site: str = "cluster_id",
    path: str = "node_ip",
    content: str = "content",
    threshold: float = 0.5,
) -> DataFrame:
    """The rows with (evidence, site_posterior, path_posterior, posterior, accepted); columns of these names are replaced.

    evidence: the classifier's probability that the dump is good. posterior:
    the same with the site hierarchy's odds. accepted: posterior >= threshold.

    Null sites and paths are groups of their own. Null and empty contents are
    judged by the model as texts without words. Repeated rows count each. An
    empty table gives an empty table. Means are taken over all rows, with
    map-side sums, so a site with a third of all rows is one row per task.
    """
    shared = dumps.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(1 / (1 + np.exp(-np.clip(margins(shared.value, texts), -30, 30))))

    kept = [c for c in dumps.columns if c not in ("evidence", "site_posterior", "path_posterior", "posterior", "accepted")]
    given = {c: f"c{i}" for i, c in enumerate(kept)}
    rows = dumps.select(
        *[F.col(f"`{c}`").alias(a) for c, a in given.items()],
        F.coalesce(F.col(site).cast("string"), F.lit("\0")).alias("site"),
        F.coalesce(F.col(path).cast("string"), F.lit("\0")).alias("path"),
        score(F.col(content).cast("string")).alias("evidence"),
    )
    # One small row per path, written once: the means below read it instead of scoring again.
    paths = stored(
        rows.groupBy("site", "path").agg(F.count("*").alias("n"), F.avg("evidence").alias("mean")), "path-evidence"
    )
    sites = paths.groupBy("site").agg(F.sum("n").alias("site_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("site_mean"))
    everything = paths.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean")).first().mean
    everything = F.lit(0.5 if everything is None else everything)
    strength = F.lit(sites.agg(_strength("site_mean", everything, "site_n").alias("k")).first().k or 1.0)
    sites = sites.select(
        "site", ((F.col("site_n") * F.col("site_mean") + strength * everything) / (F.col("site_n") + strength)).alias("site_posterior")
    )
    paths = paths.join(sites, "site")
    strength = F.lit(paths.agg(_strength("mean", F.col("site_posterior"), "n").alias("k")).first().k or 1.0)
    paths = paths.select(
        "site", "path", "site_posterior",
        ((F.col("n") * F.col("mean") + strength * F.col("site_posterior")) / (F.col("n") + strength)).alias("path_posterior"),
    )
    odds = _logit(F.col("evidence")) + _logit(F.col("path_posterior")) - _logit(everything)
    return (
        rows.join(paths, ["site", "path"])
        .withColumn("posterior", 1 / (1 + F.exp(-odds)))
        .select(
            *[F.col(a).alias(c) for c, a in given.items()],
            "evidence", "site_posterior", "path_posterior", "posterior",
            (F.col("posterior") >= threshold).alias("accepted"),
        )
    )
