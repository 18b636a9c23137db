import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetvitals.llm import quality as Q


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(600)]
    rows = []
    for i in range(n):
        site = rng.randrange(8)
        bad = rng.random() < (0.6 if site == 0 else 0.1)
        text = [rng.choice(words) for _ in range(rng.randrange(20, 200))]
        if bad:
            text = [w.upper() + "!!" for w in text[:20]] * 3 if rng.random() < 0.5 else [*text, *rng.sample(["vile", "rotten", "awful"], 2)]
        rows.append((i, f"c{site}", f"n{rng.randrange(3)}", " ".join(text), int(not bad)))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = corpus(1, 1500)
    dumps = spark.createDataFrame([r[:4] for r in rows], "dump_id long, cluster_id string, node_ip string, content string")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows], "dump_id long, good int")
    return Q.train(dumps, labels)


def test_held_out_dumps(spark, model):
    rows = corpus(2)
    dumps = spark.createDataFrame([r[:4] for r in rows], "dump_id long, cluster_id string, node_ip string, content string")
    found = {r.dump_id: r for r in Q.classify(dumps, model).collect()}
    good = [found[r[0]].accepted for r in rows if r[4]]
    bad = [found[r[0]].accepted for r in rows if not r[4]]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.05 * len(bad)
    # The bad site's posterior is below the others'.
    posterior = {r.cluster_id: r.site_posterior for r in found.values()}
    assert min(posterior, key=posterior.get) == "c0"


def test_same_means_as_plain_python(spark, model):
    rows = corpus(3, 120)
    dumps = spark.createDataFrame([r[:4] for r in rows], "dump_id long, cluster_id string, node_ip string, content string")
    found = Q.classify(dumps, model).toPandas()
    mean = found.evidence.mean()
    sites = found.groupby("cluster_id").evidence.agg(["mean", "count"])
    n = len(found)
    within = mean * (1 - mean)
    between = (sites["count"] * (sites["mean"] - mean) ** 2).sum() / n - len(sites) * within / n
    k = min(max(within / max(between, 1e-9) - 1, 1), 10000)
    expected = (sites["count"] * sites["mean"] + k * mean) / (sites["count"] + k)
    for site, value in expected.items():
        assert found[found.cluster_id == site].site_posterior.iloc[0] == pytest.approx(value)
    assert ((found.path_posterior > 0) & (found.path_posterior < 1)).all()


def test_sparse_sites_shrink_to_the_mean(spark):
    """Evidence fixed by a model of one word: a site of one bad dump stays near all."""
    import numpy as np

    model = Q.Model(np.zeros(1 << Q.BITS), np.zeros(Q.SHAPES), 0.0)
    rows = [(i, "big", "p", "x") for i in range(50)] + [(100, "small", "p", "x")]
    found = Q.classify(spark.createDataFrame(rows, "dump_id long, cluster_id string, node_ip string, content string"), model)
    assert {round(r.posterior, 6) for r in found.collect()} == {0.5}


def test_odd_rows(odd, nothing, spark, model):
    for m in (model, Q.train(nothing, nothing.withColumn("good", F.lit(1)))):
        found = Q.classify(odd, m)
        assert found.count() == odd.count()
        assert set(odd.columns) <= set(found.columns)
        assert Q.classify(nothing, m).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (55, 1)], "dump_id long, good int")
    assert Q.classify(odd, Q.train(odd, labels)).where("accepted").count() == odd.count()


def test_repeated_rows_weigh_once_in_the_fit(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Q, "fit", lambda bounds, slots, shapes, good: seen.append((len(good), shapes.shape, slots.tolist())))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "dump_id long, good int")
    rows = [(1, "good words"), (2, "bad words here")]
    for repeats in (1, 50):
        Q.train(spark.createDataFrame(rows * repeats, "dump_id long, content string").repartition(3), labels)
    assert seen[0] == seen[1] and seen[1][0] == 2


def test_fit_takes_little_beside_its_sample():
    """The driver fits: what it needs beside the sample, above all to find telling words, does not grow with it."""
    n, each = 4000, 500
    rng = np.random.default_rng(1)
    slots = np.sort(rng.integers(0, 1 << Q.BITS, (n, each), dtype=np.int32), axis=1).ravel()
    bounds, shapes, good = np.arange(n + 1) * each, rng.random((n, Q.SHAPES)), (rng.random(n) < 0.8).astype(float)
    tracemalloc.start()
    Q.fit(bounds, slots, shapes, good, epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * slots.nbytes
