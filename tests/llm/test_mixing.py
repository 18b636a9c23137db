import numpy as np
import pytest

from fleetvitals.llm import mixing
from tests.llm import brute


def test_targets():
    for sizes in ({"a": 100, "b": 100, "c": 100}, {"a": 5, "b": 1000, "c": 10, None: 70}, {"z": 1}, {"a": 0, "b": 0}, {"a": 0, "b": 9}, {}):
        found = mixing.targets(sizes, (3, 1, 2), 1.5, 2.0)
        assert found == pytest.approx(brute.targets(sizes))
        assert all(v <= 2 * sizes[s] + 1e-9 for s, v in found.items())


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 7, 64, 1000):
        for key in (0, 5, 1 << 60):
            assert sorted(mixing.permuted(np.arange(n), n, np.uint64(key)).tolist()) == list(range(n))
    assert mixing.permuted(np.arange(100), 100, np.uint64(1)).tolist() != list(range(100))


def test_shards_add_up_and_vary_as_draws_do():
    slots = np.array([1000, 300, 0, 77])
    shards, size = 14, 100
    before = np.zeros(4, dtype=int)
    counts = []
    for shard in range(shards):
        start, here = mixing.shard_counts(slots, shards, size, shard, seed=3)
        assert (start == before).all() and here.sum() == min(size, 1377 - shard * size)
        before = before + here
        counts.append(here[0])
    assert (before == slots).all()
    assert len(set(counts[:-1])) > 1


@pytest.fixture(scope="module")
def dumps(spark):
    rng = np.random.default_rng(0)
    rows = [(i, None if s == 4 else f"c{s}", "w " * int(rng.integers(0, 400))) for i, s in enumerate(rng.choice(5, 300, p=[0.5, 0.2, 0.1, 0.1, 0.1]))]
    return spark.createDataFrame(rows, "dump_id long, cluster_id string, content string")


def test_mix_hits_targets(dumps):
    found = mixing.mix_sources(dumps).toPandas()
    rows = {r.dump_id: r for r in dumps.collect()}
    sizes = {}
    for r in rows.values():
        sizes[r.cluster_id] = sizes.get(r.cluster_id, 0) + len(r.content.split())
    wanted = brute.targets(sizes)
    taken = {}
    assert len(found) == len(rows)
    for r in found.itertuples():
        source = rows[r.dump_id].cluster_id
        assert r.size == len(rows[r.dump_id].content.split()) and r.source_size == sizes[source]
        assert r.target == pytest.approx(wanted[source]) and 0 <= r.taken <= 2 * r.size
        taken[source] = taken.get(source, 0) + r.taken
    for source, words in taken.items():
        assert abs(words - wanted[source]) <= 200


def test_reruns_agree_whatever_the_partitions(dumps):
    one, two = (
        sorted(map(tuple, mixing.mix_sources(d).select("dump_id", "taken").collect())) for d in (dumps.repartition(1), dumps.repartition(7))
    )
    assert one == two
    assert one != sorted(map(tuple, mixing.mix_sources(dumps, seed=8).select("dump_id", "taken").collect()))


def test_odd_rows(odd, nothing):
    found = mixing.mix_sources(odd, block_words=4).collect()
    assert len(found) == odd.count()
    assert all(r.taken <= 2 * r.size for r in found)
    assert {r.dump_id: r.size for r in found if r.dump_id} == {1: 10, 2: 10, 3: 0, 4: 0, 5: 0, 6: 4, 7: 1}
    assert {r.source_size for r in found} == {30, 15, 0}
    assert mixing.mix_sources(nothing).count() == 0
