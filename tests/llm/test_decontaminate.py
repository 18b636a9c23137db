import random

import pytest

from fleetvitals.llm import decontaminate
from tests.llm import brute


def corpus():
    rng = random.Random(5)
    items = [(f"q{i}", " ".join(f"i{rng.randrange(900)}" for _ in range(rng.choice([0, 1, 5, 12, 13, 14, 40])))) for i in range(40)]
    items += [("null", None), ("marks", "!!! --- ..."), ("Ünï", "Straße über Äpfel"), ("copy", items[6][1])]
    texts = {}
    for i in range(60):
        words = [f"d{rng.randrange(10**5)}" for _ in range(rng.randrange(200))]
        part = (rng.choice(items)[1] or "").split()
        low = rng.randrange(len(part) + 1)
        at = rng.randrange(len(words) + 1)
        words[at:at] = part[low:] if rng.random() < 0.4 else part
        texts[i] = rng.choice([" ", ", ", " - "]).join(w.upper() if rng.random() < 0.3 else w for w in words)
    texts |= {100: "über äPFEL Straße über Äpfel", 101: "", 102: None, 103: " ".join(w for _, t in items if t for w in t.split())}
    return texts, items


@pytest.mark.parametrize("most", [250_000, 30])
def test_same_as_brute_force(spark, most):
    texts, items = corpus()
    dumps = spark.createDataFrame(list(texts.items()), "dump_id long, content string")
    table = spark.createDataFrame(items, "item_id string, text string")
    found = {r.dump_id: r for r in decontaminate.find_contamination(dumps, table, max_windows=most).collect()}
    expected = brute.contamination(texts, items)
    assert any(e[3] for e in expected.values())
    for i, (n, hit, names, bad) in expected.items():
        r = found[i]
        assert (r.n_words, r.n_hit, r["items"], r.n_items, r.contaminated) == (n, hit, names, len(names), bad)
        assert r.items_sha256 == brute.sha(",".join(names))
        # Offsets lead back to the original text.
        words = [w for a, b in r.spans for w in brute.NORMAL.findall(texts[i][a:b])]
        assert len(words) == hit
        assert all(not a or not brute.NORMAL.fullmatch(texts[i][a - 1]) for a, _ in r.spans)


def test_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame([(1, "one two three"), (None, "solo"), (2, None), (3, "")], "item_id long, text string")
    found = decontaminate.find_contamination(odd, items).collect()
    assert len(found) == odd.count()
    # An item without an id makes its words hits, but has no name to report.
    assert sorted(str(r.dump_id) for r in found if r.contaminated) == ["1", "2", "2", "7", "None"]
    solo = next(r for r in found if r.dump_id == 7)
    assert (solo.n_hit, solo.n_items, solo.items_sha256) == (1, 0, brute.sha(""))
    assert decontaminate.find_contamination(nothing, items).count() == 0
    assert not any(r.contaminated for r in decontaminate.find_contamination(odd, items.limit(0)).collect())


def test_automata_are_bounded_by_their_characters(spark, monkeypatch):
    """300,000 windows: no automaton has more nodes than characters are allowed, and every item is still found."""
    sizes, build = [], decontaminate.build_automaton
    monkeypatch.setattr(decontaminate, "build_automaton", lambda *a: sizes.append((got := build(*a))[0].get_stats()["nodes_count"]) or got)
    words = [f"{i:x}" for i in range(3012)]
    items = [(f"i{k}", " ".join(f"{w}k{k}" for w in words)) for k in range(100)]
    dumps = spark.createDataFrame([(k, " ".join(f"{w}k{k}" for w in words[k : k + 13])) for k in range(0, 100, 9)], "dump_id long, content string")
    table = spark.createDataFrame(items, "item_id string, text string")
    most = 8_000_000
    found = {r.dump_id: (r.n_hit, r["items"]) for r in decontaminate.find_contamination(dumps, table, max_characters=most).collect()}
    assert found == {k: (13, [f"i{k}"]) for k in range(0, 100, 9)}
    assert len(sizes) > 2 and max(sizes) <= most and sum(map(len, (w for _, t in items[:1] for w in decontaminate.item_windows(t, 13)))) * 100 > 2 * most
