import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetvitals.llm import ngram_join
from tests.llm import brute


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = base[:]
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        out.append(words)
    return out


def corpus(seed=1):
    """Families of near copies of many sizes, around the threshold, and texts that share one passage."""
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(5000)}"
    texts = []
    for size in (1, 2, 3, 5, 6, 7, 8, 9, 11, 13, 14, 16, 20, 30, 60, 150, 400):
        base = [word() for _ in range(size)]
        texts += family(rng, base, 6, max(1, size // 20))
        texts += [base[:k] for k in (size - 1, size - 2) if k > 0] + [[*base, word()]]
    passage = [word() for _ in range(40)]
    texts += [[word() for _ in range(rng.randrange(60))] + passage + [word() for _ in range(rng.randrange(60))] for _ in range(40)]
    rng.shuffle(texts)
    return [(i * 3 + 5, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("n", "percent", "chunk"), [(4, 85, 10**6), (5, 80, 10**6), (2, 60, 300), (4, 85, 200), (1, 95, 100)])
def test_same_groups_as_brute_force(spark, n, percent, chunk):
    rows = corpus()
    dumps = spark.createDataFrame(rows, "dump_id long, content string").repartition(5)
    found = ngram_join.near_duplicates(dumps, n, percent, chunk_ngrams=chunk).collect()
    sets = {i: brute.ngrams(t, n) for i, t in rows}
    groups = brute.components(sets, percent)
    assert {r.dump_id: (r.n_shingles, r.component_id) for r in found} == {i: (len(sets[i]), groups[i]) for i in sets}


def test_large_block_of_near_copies_is_cut_into_chunks(spark):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(50)]
    rows = [(i, " ".join(w)) for i, w in enumerate(family(rng, base, 80, 2))]
    dumps = spark.createDataFrame(rows, "dump_id long, content string")
    found = ngram_join.near_duplicates(dumps, 3, 80, chunk_ngrams=400).collect()
    groups = brute.components({i: brute.ngrams(t, 3) for i, t in rows}, 80)
    assert {r.dump_id: r.component_id for r in found} == groups


def test_odd_rows(odd, nothing):
    found = ngram_join.near_duplicates(odd).collect()
    assert len(found) == odd.count()
    by_id = {r.dump_id: (r.n_shingles, r.component_id) for r in found if r.dump_id is not None}
    assert by_id == {1: (6, 1), 2: (6, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (1, 6), 7: (1, 7)}
    assert all(r.component_id is None for r in found if r.dump_id is None)
    assert ngram_join.near_duplicates(nothing).count() == 0


def test_runs_on_statements(spark):
    """The library's own records: statements of slow logs that differ in a literal."""
    entries = spark.createDataFrame(
        [(1, "select a b c d e f g h from orders where id = 1"), (2, "select a b c d e f g h from orders where id = 2"), (3, "delete from t")],
        "id long, sql string",
    )
    found = ngram_join.near_duplicates(entries, 2, 80, dump_id="id", content="sql").orderBy("id")
    assert [r.component_id for r in found.collect()] == [1, 1, 3]


def test_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(200_000))
    dumps = spark.createDataFrame([(1, text), (2, text + " end"), (3, "x" * 3_000_000)], "dump_id long, content string")
    found = {r.dump_id: r for r in ngram_join.near_duplicates(dumps, 4, 85).collect()}
    assert found[2].component_id == 1 and found[1].n_shingles == 199_997 and found[3].n_shingles == 1


def test_components_of_a_chain(spark):
    from fleetvitals.llm.components import components

    links = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = components(links.unionByName(spark.createDataFrame([(100, 101)], "a long, b long"))).collect()
    assert {r.node: r.component for r in found} == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def block_groups(sets, percent):
    block = ngram_join.Block([np.sort(np.array([*s], dtype=np.uint64)) for s in sets], percent)
    links = block.links(range(len(sets)))
    assert all(100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]) for x, y in links)
    return block, [block.find(i) for i in range(len(sets))]


@pytest.mark.parametrize("sweep", [0, 10_000, 1 << 40])
@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_walks_and_sweeps_of_a_block(monkeypatch, sweep, percent):
    """By branches, by whole trees, or either: groups are those of all pairs."""
    monkeypatch.setattr(ngram_join, "SWEEP_NGRAMS", sweep)
    rng = random.Random(percent)
    sets = []
    for size in (1, 2, 3, 8, 30, 90):
        base = [rng.randrange(400) for _ in range(size)]
        sets += [{rng.randrange(10**6) if rng.random() < rng.choice((0, 0.05, 0.15, 0.3)) else v for v in base} for _ in range(25)]
    rng.shuffle(sets)
    _, found = block_groups(sets, percent)
    expected = brute.components(dict(enumerate(sets)), percent)
    assert len(set(zip(found, expected.values(), strict=True))) == len(set(found)) == len(set(expected.values())) < len(sets)


def test_copies_and_a_common_passage_do_not_make_every_pair_meet():
    """A block as check_h has it: near copies, and sets that share a passage only; none of the latter looks at the others' branches."""
    rng = random.Random(5)
    passage, rest = [rng.randrange(1 << 60) for _ in range(100)], lambda n: [rng.randrange(1 << 60) for _ in range(n)]
    copies = [{*passage, *rest(5)} for _ in range(200)]
    others = [{*passage, *rest(60)} for _ in range(300)]
    block, found = block_groups([others[0], *copies, *others[1:]], 80)
    assert len(set(found)) == 301 and len(set(found[1:201])) == 1
    assert block.visits < 10 * 500
