import random

import pytest

from fleetvitals.llm import passages
from tests.llm import brute


def corpus(seed, window):
    rng = random.Random(seed)
    shared = [[f"p{j}_{i % 7 if j == 0 else i}" for i in range(rng.randrange(window - 3, 4 * window))] for j in range(6)]
    texts = {}
    for i in range(60):
        words = []
        for _ in range(rng.randrange(4)):
            words += [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(2 * window))]
            passage = rng.choice(shared)
            low = rng.randrange(len(passage) // 2)
            words += passage[low : rng.randrange(low + 1, len(passage) + 1)] if rng.random() < 0.5 else passage
        texts[i * 2] = " ".join(words)
    texts[200] = texts[100]
    texts[202] = "a b a b " * 80
    texts[204] = "b a b a " * 80
    return texts


@pytest.mark.parametrize(("seed", "window"), [(1, 10), (2, 25), (3, 50), (4, 8), (5, 3)])
def test_same_as_brute_force(spark, seed, window):
    texts = corpus(seed, window)
    dumps = spark.createDataFrame(list(texts.items()), "dump_id long, content string").repartition(4)
    found = {r.dump_id: r for r in passages.remove_passages(dumps, window).collect()}
    expected = brute.passages(texts, window)
    assert any(sum(gone) for _, gone, _ in expected.values())
    for i, (n, gone, kept) in expected.items():
        assert (found[i].n_words, found[i].n_removed, found[i].kept_text) == (n, sum(gone), kept)
        flat = [k for a, b in found[i].spans for k in range(a, b)]
        assert flat == [k for k, g in enumerate(gone) if g]


def test_odd_rows(odd, nothing):
    found = passages.remove_passages(odd, window=5).collect()
    assert len(found) == odd.count()
    twos = [r for r in found if r.dump_id == 2]
    assert [(r.n_words, r.n_removed, r.kept_text) for r in twos] == [(10, 10, "")] * 2
    one = next(r for r in found if r.dump_id == 1)
    assert (one.n_removed, one.kept_text) == (0, "one two three four five six seven eight nine ten")
    assert sorted((r.n_words, r.n_removed) for r in found if r.dump_id is None) == [(0, 0), (10, 0)]
    assert passages.remove_passages(nothing).count() == 0


def test_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(150_000))
    dumps = spark.createDataFrame([(1, text), (2, "start " + text)], "dump_id long, content string")
    found = {r.dump_id: r for r in passages.remove_passages(dumps).collect()}
    assert found[1].n_removed == 0 and found[2].kept_text == "start"
