import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetvitals.llm import hard_negatives as H

SCHEMA = "item_id long, vector array<float>, label int"


def brute(rows, anchors, n_positives=5, n_negatives=10, low=30, high=90, scale=256.0):
    kept = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = tuple(int(math.floor(scale * float(np.float32(x)))) for x in v)
        kept[(i, v, label)] = None
    out = set()
    for a, v, label in kept:
        if not anchors(a):
            continue
        scored = {(sum(x * y for x, y in itertools.zip_longest(v, w, fillvalue=0)), i, other == label) for i, w, other in kept if i != a}
        positives = sorted({(-s, i) for s, i, same in scored if same})[:n_positives]
        for p, i in positives:
            fit = sorted({(-s, j) for s, j, same in scored if not same and low * -p <= 100 * s <= high * -p})[:n_negatives]
            out |= {(a, i, rank, j, -p, -s) for rank, (s, j) in enumerate(fit, 1)}
    return sorted(out)


def table(kind, n=400, dims=12):
    rng = np.random.default_rng(5)
    if kind == "spread":
        v = rng.normal(size=(n, dims))
    elif kind == "clustered":
        v = rng.normal(size=(8, dims))[rng.integers(0, 8, n)] + rng.normal(size=(n, dims)) * 0.02
    elif kind == "ties":
        v = rng.integers(-1, 2, size=(n, dims))
    else:  # a third of all rows have one vector
        v = rng.normal(size=(n, dims))
        v[: n // 3] = v[0]
    labels = rng.integers(0, 3, n)
    return [(i, [float(x) for x in v[i]], int(labels[i])) for i in range(n)]


@pytest.mark.parametrize("kind", ["spread", "clustered", "ties", "hot"])
def test_against_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 16)
    monkeypatch.setattr(H, "PASS_BYTES", 4000)  # several blocks and several passes
    monkeypatch.setattr(H, "PIECE", 64)
    rows = table(kind)
    given = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = H.mine_hard_negatives(given, F.col("item_id") % 7 == 0)
    assert sorted(map(tuple, found.collect())) == brute(rows, lambda i: i % 7 == 0)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        *table("ties", 60, 3), (None, [1.0, 1.0, 1.0], 1), (200, None, 1), (201, [1.0, None, 0.0], 1), (202, [nan, 0.0, 0.0], 1),
        (203, [inf, 0.0, 0.0], 1), (204, [1.0, 1.0, 1.0], None), (205, [], 1), (206, [2.0], 0), (207, [1.0, 1.0, 1.0, 5.0], 2),
        *table("ties", 20, 3), (3, [1.0, 1.0, 0.0], 2), (210, [1000.0, -1000.0, 3.0], 2), (7, [0.0, 0.0, 0.0], 1),
    ]
    given = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "code", "score", "anchor", "rank", "tree")})
    found = H.mine_hard_negatives(given, F.col("item_id") % 7 == 0)
    assert sorted(set(map(tuple, found.collect()))) == brute(rows, lambda i: i % 7 == 0)


def test_nothing_and_no_anchors(spark):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    for rows in ([], table("spread", 20)):
        found = H.mine_hard_negatives(spark.createDataFrame(rows, SCHEMA), F.lit(False))
        assert found.count() == 0 and found.columns == names


def test_bounds_spare_scores(monkeypatch):
    """Near anchors are scored through their parent: few candidates need a product of their own."""
    rng = np.random.default_rng(1)
    middle = rng.normal(size=32) * 256
    anchors = np.floor(middle + rng.normal(size=(64, 32)))
    candidates = np.floor(rng.normal(size=(2000, 32)) * 256)
    tree = H.spanning_tree(np.arange(64), np.array(["a"] * 64, dtype=object), anchors)
    assert (tree.parent < np.arange(64)).all() and sum(tree.parent < 0) == 1
    scored, products = [], H.products
    monkeypatch.setattr(H, "products", lambda a, b: scored.append(len(a) * len(b)) or products(a, b))
    exact = tree.vectors @ candidates.T
    low = np.quantile(exact, 0.97, axis=1)
    a, c, s = H.scores_in_windows(tree, candidates, np.ones(exact.shape, bool), low, np.full(64, np.inf))
    assert sorted(zip(a.tolist(), c.tolist(), strict=True)) == sorted(zip(*(x.tolist() for x in np.nonzero(exact >= low[:, None])), strict=True))
    assert (s == exact[a, c]).all() and sum(scored) < 0.2 * exact.size


def test_profiles_of_nodes(spark):
    """A node's figures as a vector, its role as the label: nodes of another role that look alike."""
    nodes = spark.createDataFrame(
        [(i, "primary" if i % 4 == 0 else "slave", 60.0 + i % 7, 10.0 * (i % 5), float(i % 3)) for i in range(40)],
        "node_id long, role string, mem_pct double, qps double, lag_seconds double",
    )
    given = nodes.select("node_id", "role", F.array("mem_pct", "qps", "lag_seconds").alias("profile"))
    found = H.mine_hard_negatives(given, F.col("node_id") < 4, item_id="node_id", vector="profile", label="role", scale=1.0).collect()
    role = {i: "primary" if i % 4 == 0 else "slave" for i in range(40)}
    assert found and all(role[r.anchor_id] == role[r.positive_id] != role[r.negative_id] for r in found)
    assert all(30 * r.positive_score <= 100 * r.negative_score <= 90 * r.positive_score for r in found)


def test_scores_beyond_exact_doubles():
    big = np.array([[2.0**40, 3.0]])
    with pytest.raises(OverflowError):
        H.products(big, big)
    assert H.products(big, np.array([[2.0**11, 1.0]])).tolist() == [[2.0**51 + 3]]
