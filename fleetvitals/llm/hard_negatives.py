"""Hard negatives: rows of another label whose score with an anchor lies near, but below, that of its positives.

The project keeps no vectors of its own, so the record is general: an id, a
vector of numbers and a label. A node's figures put into an array, with its
role as the label, are such a record. Scores are exact integers: components are
quantised to floor(scale * x) and multiplied out.

Anchors are cut into blocks of near ones, each block joined by a minimum
spanning tree over the anchors' distances. A candidate c whose score with a
parent anchor p is known, or bounded, has with the child a a score within
    score(p, c) - |a - p| |c|  and  score(p, c) + |a - p| |c|.
Only candidates whose interval meets the window the anchor still asks for are
scored. For positives the window is "above the worst of the best so far", for
negatives the union of the score windows of the anchor's positives, each cut
off below the worst of its best so far.

The candidates are never shuffled: each pass broadcasts anchors of PASS_BYTES
at most and reads the candidates where they lie; tasks pass on their best only.
More anchors take more passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetvitals.llm.storage import stored
from fleetvitals.operators.ranking import top_k

BLOCK = 512  # anchors of one tree
PASS_BYTES = 8 << 20  # anchors broadcast at once
FIRST_PIECE, PIECE = 128, 2048  # candidates scored at once; the first ones are few, to learn what to ask for
MANY = 0.2  # from this share of candidates on, an anchor's whole row is one matrix product
CODE = 16  # leading components whose signs order the anchors
EXACT = float(1 << 53)  # below, sums of products are exact in double precision
SCHEMA = "id long, label string, vector array<double>"


@dataclass
class Tree:
    """A block's anchors, parents before children."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    parent: np.ndarray  # -1 at the root
    edge: np.ndarray  # distance to the parent, rounded up

    def __post_init__(self) -> None:
        depth = np.zeros(len(self.ids), dtype=np.int64)
        for i in range(1, len(depth)):
            depth[i] = depth[self.parent[i]] + 1
        self.levels = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1)]
        self._code_of = {label: i for i, label in enumerate(dict.fromkeys(self.labels))}
        self.codes = np.array([self._code_of[label] for label in self.labels])

    def same_label(self, labels: np.ndarray) -> np.ndarray:
        """Anchors x candidates."""
        return self.codes[:, None] == np.array([self._code_of.get(label, -1) for label in labels])[None, :]


def rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, vectors); vectors of fewer components are filled up with zeros."""
    ids = batch.column(0).to_numpy()
    labels = np.array(batch.column(1).to_pylist(), dtype=object)
    lists = batch.column(2)
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(lengths.max()) if len(lengths) else 0
    out = np.zeros((len(ids), width))
    row = np.repeat(np.arange(len(ids)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return ids, labels, out


def _widened(vectors: np.ndarray, width: int) -> np.ndarray:
    return np.pad(vectors, ((0, 0), (0, width - vectors.shape[1]))) if vectors.shape[1] < width else vectors


def _norms(vectors: np.ndarray) -> np.ndarray:
    """Lengths, rounded up."""
    return np.sqrt((vectors**2).sum(axis=1)) * (1 + 1e-9)


def spanning_tree(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Tree:
    """Minimum spanning tree by Prim, from the anchor nearest to the middle."""
    n = len(ids)
    root = int(np.argmin(((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1)))
    near, via = np.full(n, np.inf), np.full(n, -1)
    order, free = [], np.ones(n, dtype=bool)
    at = root
    while True:
        order.append(at)
        free[at] = False
        if len(order) == n:
            break
        away = ((vectors - vectors[at]) ** 2).sum(axis=1)
        closer = free & (away < near)
        near[closer], via[closer] = away[closer], at
        at = int(np.argmin(np.where(free, near, np.inf)))
        if near[at] == np.inf:  # distances beyond what a double holds
            at = int(np.flatnonzero(free)[0])
            via[at] = root
    take = np.array(order)
    place = np.empty(n, dtype=np.int64)
    place[take] = np.arange(n)
    parent = np.where(via[take] >= 0, place[via[take]], -1)
    edge = np.where(parent >= 0, np.sqrt(near[take]), 0) * (1 + 1e-9)
    return Tree(ids[take], labels[take], vectors[take], parent, edge)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a with those of b."""
    width = max(a.shape[1], b.shape[1])
    a, b = _widened(a, width), _widened(b, width)
    if not a.size or not b.size or _norms(a).max() * _norms(b).max() < EXACT:
        return a @ b.T
    whole = np.array([[int(x) for x in r] for r in a], dtype=object) @ np.array([[int(x) for x in r] for r in b], dtype=object).T
    if whole.size and max(abs(x) for x in whole.ravel()) >= 1 << 53:
        raise OverflowError("a score of 2^53 or more: choose a smaller scale")
    return whole.astype(np.float64)


def scores_in_windows(
    tree: Tree, candidates: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, candidate, score) of every wanted pair whose score lies within its anchor's low .. high.

    wanted: anchors x candidates. Walks the tree level by level; what the
    parents' bounds rule out is not scored.
    """
    m, n = len(tree.ids), len(candidates)
    norms = _norms(candidates)
    least, most = np.empty((m, n)), np.empty((m, n))
    found = []
    for level in tree.levels:
        parents = tree.parent[level]
        if parents[0] < 0:
            open_ = np.ones((len(level), n), dtype=bool)
        else:
            slack = tree.edge[level][:, None] * norms + 1e-3
            least[level], most[level] = least[parents] - slack, most[parents] + slack
            open_ = wanted[level] & (most[level] >= low[level][:, None]) & (least[level] <= high[level][:, None])
        share = open_.mean(axis=1) if n else np.zeros(len(level))
        dense = level[share >= MANY]
        if len(dense):
            exact = products(tree.vectors[dense], candidates)
            least[dense] = most[dense] = exact
            a, c = np.nonzero(wanted[dense] & (exact >= low[dense][:, None]) & (exact <= high[dense][:, None]))
            found.append((dense[a], c, exact[a, c]))
        for k in np.flatnonzero((share < MANY) & (share > 0)):
            anchor, c = level[k], np.flatnonzero(open_[k])
            exact = products(tree.vectors[anchor : anchor + 1], candidates[c])[0]
            least[anchor, c] = most[anchor, c] = exact
            hit = (exact >= low[anchor]) & (exact <= high[anchor])
            found.append((np.full(int(hit.sum()), anchor), c[hit], exact[hit]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    a, c, s = (np.concatenate(x) for x in zip(*found, strict=True))
    return a, c, s


@dataclass
class Best:
    """Per key the first k (score downwards, id upwards) of what was added."""

    k: int
    keys: np.ndarray
    scores: np.ndarray
    ids: np.ndarray

    @classmethod
    def none(cls, k: int) -> Best:
        return cls(k, np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))

    def add(self, keys: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        keys, scores, ids = np.concatenate((self.keys, keys)), np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
        order = np.lexsort((ids, -scores, keys))
        again = (keys[order][1:] == keys[order][:-1]) & (scores[order][1:] == scores[order][:-1]) & (ids[order][1:] == ids[order][:-1])
        order = order[np.concatenate(([True], ~again))[: len(order)]]
        keys = keys[order]
        kept = np.arange(len(keys)) - np.searchsorted(keys, keys) < self.k
        self.keys, self.scores, self.ids = keys[kept], scores[order][kept], ids[order][kept]

    def worst(self, n: int) -> np.ndarray:
        """Per key 0 .. n - 1 the score that a further one must reach; minus infinity where there are fewer than k."""
        out = np.full(n, -np.inf)
        ends = np.flatnonzero(np.diff(np.append(self.keys, -1)) != 0)
        full = ends[np.diff(np.concatenate(([-1], ends))) == self.k]
        out[self.keys[full]] = self.scores[full]
        return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    size = FIRST_PIECE
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            yield rows_of(batch.slice(at, size))
            at += size
            size = PIECE


def _emit(best: list[Best], columns: list[str]) -> Iterator[pa.RecordBatch]:
    for block, b in enumerate(best):
        if len(b.keys):
            of = pa.array(np.full(len(b.keys), block), pa.int64())
            yield pa.RecordBatch.from_arrays([of, pa.array(b.keys), pa.array(b.ids), pa.array(b.scores.astype(np.int64))], names=columns)


def _positives(rows: DataFrame, trees: list[Tree], k: int) -> DataFrame:
    """(block, anchor, item_id, score): per task and anchor its best k of the same label."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        best = [Best.none(k) for _ in trees]
        for ids, labels, vectors in _pieces(batches):
            for tree, b in zip(trees, best, strict=True):
                wanted = tree.same_label(labels) & (tree.ids[:, None] != ids[None, :])
                floor = b.worst(len(tree.ids))
                a, c, s = scores_in_windows(tree, vectors, wanted, floor, np.full(len(tree.ids), np.inf))
                b.add(a, s, ids[c])
        yield from _emit(best, ["block", "anchor", "item_id", "score"])

    return rows.mapInArrow(work, "block long, anchor long, item_id long, score long")


def _negatives(rows: DataFrame, trees: list[Tree], windows: list[tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """(block, anchor_window, item_id, score): per task and window its best k of another label.

    windows: per tree, the low and the high ends (anchors x windows); an unused window is (inf, -inf).
    """
    shared = rows.sparkSession.sparkContext.broadcast((trees, windows))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, windows = shared.value
        best = [Best.none(k) for _ in trees]
        for ids, labels, vectors in _pieces(batches):
            for tree, (low, high), b in zip(trees, windows, best, strict=True):
                n, w = low.shape
                floor = np.maximum(low, b.worst(n * w).reshape(n, w))
                wanted = ~tree.same_label(labels) & (tree.ids[:, None] != ids[None, :])
                a, c, s = scores_in_windows(tree, vectors, wanted, floor.min(axis=1, initial=np.inf), high.max(axis=1, initial=-np.inf))
                for i in range(w):
                    hit = (s >= floor[a, i]) & (s <= high[a, i])
                    b.add(a[hit] * w + i, s[hit], ids[c[hit]])
        yield from _emit(best, ["block", "anchor_window", "item_id", "score"])

    return rows.mapInArrow(work, "block long, anchor_window long, item_id long, score long")


def plant_trees(anchors: DataFrame, n_anchors: int, block: int = BLOCK) -> DataFrame:
    """One row per block of near anchors: (n, ids, labels, width, vectors, parent, edge)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                t = spanning_tree(*rows_of(batch.slice(at, block)))
                yield pa.RecordBatch.from_pydict(
                    {
                        "n": [len(t.ids)], "ids": [t.ids.tolist()], "labels": [t.labels.tolist()], "width": [t.vectors.shape[1]],
                        "vectors": [t.vectors.tobytes()], "parent": [t.parent.tolist()], "edge": [t.edge.tolist()],
                    }
                )

    schema = "n long, ids array<long>, labels array<string>, width long, vectors binary, parent array<long>, edge array<double>"
    signs = F.array_join(F.transform(F.slice("vector", 1, CODE), lambda x: F.when(x < 0, "0").otherwise("1")), "")
    near = anchors.withColumn("code", signs).repartitionByRange(max(1, -(-n_anchors // block)), "code", "id")
    return near.sortWithinPartitions("code", "id").select("id", "label", "vector").mapInArrow(work, schema)


def mine_hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    item_id: str = "item_id",
    vector: str = "vector",
    label: str = "label",
    n_positives: int = 5,
    n_negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: float = 256.0,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A row's score with an anchor is the inner product of floor(scale * x) over
    the components; higher scores come first, ties by smaller id. An anchor's
    positives are its first n_positives other rows of the same label. Of the
    rows of other labels with low * positive_score <= 100 * negative_score <=
    high * positive_score the first n_negatives are returned, ranked from 1, per
    anchor and positive; there are none where the positive's score is negative.

    Rows without an id, label or vector, or with a null, NaN or infinite
    component, take no part. A missing component of a shorter vector counts as
    zero. "Other rows" are those of other ids. Rows that share the id and the score
    with an anchor count once, rows that share the id only count each. Labels are compared as
    text. Other columns of any name do not matter; an empty table, or one
    without anchors, gives none. Scores of 2^53 or more in size raise an error.
    """
    spark = vectors.sparkSession
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = vectors.where(F.col(item_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & finite)
    quantised = F.transform(vector, lambda x: _floor(x.cast("double") * scale))
    given = {"id": F.col(item_id).cast("long"), "label": F.col(label).cast("string"), "vector": quantised}
    rows = whole.select(*[c.alias(name) for name, c in given.items()])
    anchors = whole.where(is_anchor).select(*[c.alias(name) for name, c in given.items()]).dropDuplicates()
    anchors = stored(anchors, "anchors")
    trees = stored(plant_trees(anchors, anchors.count()), "anchor-trees").withColumn("tree", F.monotonically_increasing_id())
    sizes = trees.select("tree", "n", "width").collect()  # three numbers for each block of anchors
    parts = []
    for numbers in _passes([(r.tree, r.n * r.width * 8) for r in sizes]):
        parts.append(_one_pass(rows, trees.where(F.col("tree").isin(numbers)), n_positives, n_negatives, low, high))
    if not parts:
        names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        return spark.createDataFrame([], ", ".join(f"{n} {'int' if n == 'rank' else 'long'}" for n in names))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _floor(x: Column) -> Column:
    """floor() as a double: beyond 2^52 a double has no fraction."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def _passes(sizes: list[tuple[int, int]]) -> Iterator[list[int]]:
    numbers, total = [], 0
    for number, size in sizes:
        if numbers and total + size > PASS_BYTES:
            yield numbers
            numbers, total = [], 0
        numbers.append(number)
        total += size
    if numbers:
        yield numbers


def _one_pass(rows: DataFrame, trees: DataFrame, n_positives: int, n_negatives: int, low: int, high: int) -> DataFrame:
    spark = rows.sparkSession
    got = [
        Tree(
            np.array(r.ids, dtype=np.int64), np.array(r.labels, dtype=object),
            np.frombuffer(r.vectors).reshape(r.n, r.width), np.array(r.parent, dtype=np.int64), np.array(r.edge),
        )
        for r in trees.orderBy("tree").collect()  # PASS_BYTES at most, or one block
    ]
    order = [F.desc("score"), F.col("item_id")]
    positives = stored(
        top_k(_positives(rows, got, n_positives).distinct(), ["block", "anchor"], order, n_positives, "place"), "positives"
    )
    # n_positives rows for each anchor of the pass.
    ends = [(np.full((len(t.ids), n_positives), np.inf), np.full((len(t.ids), n_positives), -np.inf)) for t in got]
    named = []
    for r in positives.collect():
        ends[r.block][0][r.anchor, r.place - 1] = -(-low * r.score // 100)
        ends[r.block][1][r.anchor, r.place - 1] = high * r.score // 100
        named.append((r.block, r.anchor * n_positives + r.place - 1, int(got[r.block].ids[r.anchor]), r.item_id, r.score))
    of = spark.createDataFrame(named, "block long, anchor_window long, anchor_id long, positive_id long, positive_score long")
    negatives = _negatives(rows, got, ends, n_negatives).distinct()
    best = top_k(negatives, ["block", "anchor_window"], order, n_negatives, "rank")
    return best.join(of, ["block", "anchor_window"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
        F.col("item_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
