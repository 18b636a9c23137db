import random

import numpy as np
import pytest

from fleetvitals.llm import personal_data as P
from tests.llm import brute

TEXTS = [
    "", "no digits here", "a@b", "a@b.c", "a@b@c.d", "x a.b+c%d@mail-1.example.com.", "a@b.c_d@e.f", "@b.c a@.c a@b..c", "1.2.3.4", "1.2.3.4.5.6.7.8",
    "300.1.1.1 1.300.1.1", "0001.2.3.4 and 00255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "41111111111111111111111", "1  2", "5 5",
    "+1 (375) 555-4393", "+1 555", "+1+2 345 678 901", "+49 30 1234567890123", "call +1 (375) 555-4393.", "é" * 50 + " 😀 a@b.co 1.2.3.4 +4 123 456 7890",
    "a@b.c1.2.3.4", "4111111111111111@x.yz", "1" * 500, "a" * 3000 + "@" + "b.c" * 5, "1.1.1.1@1.1.1.1", "+" * 40 + "1 234 567 890",
]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(2)
    alphabet = "ab1.29@+- ()%_\n"
    noise = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    for text in TEXTS + noise:
        assert P.base_spans(text) == brute.personal(text), text


def test_windows_cover_every_trigger():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("a" * 30 + "1@ ") for _ in range(rng.randrange(600)))
        starts = P.window_starts(text)
        seen = {k for s in starts for k in range(s, s + P.WINDOW)}
        assert all(k in seen for i, c in enumerate(text) if c in "1@" for k in range(max(0, i - P.MARGIN), min(len(text), i + P.MARGIN)))


def test_gradient_is_the_slope():
    rng = np.random.default_rng(1)
    tagger = P.Tagger.new(3)
    codes, mask = P.encode(["call +1 23 x", "a@b.c or 1.2.3.4 and more text"])
    tags = np.where(mask, rng.integers(0, P.TAGS, mask.shape), 0)
    _, grad = tagger.gradients(codes, mask, tags)
    for name, weights in tagger.p.items():
        for at in {tuple(rng.integers(0, s) for s in weights.shape) for _ in range(4)} | {tuple(np.unravel_index(np.abs(grad[name]).argmax(), weights.shape))}:
            old, eps = weights[at], 1e-5
            weights[at] = old + eps
            up, _ = tagger.gradients(codes, mask, tags)
            weights[at] = old - eps
            down, _ = tagger.gradients(codes, mask, tags)
            weights[at] = old
            assert grad[name][at] == pytest.approx((up - down) / (2 * eps), abs=1e-6), (name, at)


def sample(rng, n):
    words = "the node was slow and a user of host said that it had no reply from us at all".split()
    out = []
    for _ in range(n):
        parts = [rng.choice(words) for _ in range(12)]
        kind = rng.randrange(5)
        digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
        value = [
            f"{rng.choice(words)}.{digits(2)}@mail{digits(1)}.example.com", ".".join(str(rng.randrange(1, 255)) for _ in range(4)),
            card(rng), f"+1 ({digits(3)}) 555-{digits(4)}", f"key={digits(5)}ab{digits(3)}",
        ][kind]
        parts.insert(6, value)
        text = " ".join(parts)
        out.append((text, brute.personal(text)))
    return out


def card(rng):
    body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(body + c for c in "0123456789" if P._luhn(body + c))


def test_model_learns_and_holds_out():
    rng = random.Random(6)
    tagger = P.fit(sample(rng, 300), epochs=14)
    right = total = wrong = 0
    for text, spans in sample(rng, 120):
        found = {s[:3] for start in P.window_starts(text)[:1] for s in [(k, start + a, start + b) for k, a, b, _ in tagger.decode([text[start : start + P.WINDOW]])[0]]}
        right += len(found & set(spans))
        wrong += len(found - set(spans))
        total += len(spans)
    assert right >= 0.9 * total and wrong <= 0.1 * total


def test_reconcile_takes_the_best_set():
    found = [("ip", 0, 10, 5.0), ("card", 5, 20, 9.0), ("phone", 20, 30, 6.0), ("ip", 0, 10, 7.0), ("email", 40, 50, 1.0), ("phone", 60, 70, 8.0)]
    assert P.reconcile(found, [("ip", 65, 66)], 4.0) == [("phone", 20, 30), ("card", 5, 20)]
    assert P.reconcile([], [], 4.0) == []


def test_odd_rows(spark, odd, nothing):
    tagger = P.fit([])
    found = P.find_personal_data(odd, tagger).collect()
    assert len(found) == odd.count() and all(r.spans == "" and r.base_sha256 == brute.sha("") for r in found)
    assert P.find_personal_data(nothing, tagger).count() == 0
    assert P.labelled_by_patterns(nothing) == [] and P.labelled_by_patterns(odd) == []


def test_results_keep_base_spans(spark):
    tagger = P.fit(sample(random.Random(1), 150), epochs=4)
    texts = TEXTS + [t for t, _ in sample(random.Random(9), 30)] + ["a1 " * 4000]
    dumps = spark.createDataFrame(list(enumerate(texts)), "dump_id long, content string")
    for r in P.find_personal_data(dumps, tagger).collect():
        base = brute.personal(texts[r.dump_id])
        assert r.base_sha256 == brute.sha(P.written(base))
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert set(base) <= set(spans) and spans == P.in_order(spans)
        added = [s for s in spans if s not in base]
        assert len(added) == r.n_added
        assert all(a >= y or b <= x for _, a, b in added for _, x, y in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in P.KINDS]


def test_labelled_dumps_hold_rare_kinds(spark):
    """Digits are common, spans are few and late in their texts: all kinds are there, within the bound."""
    rng = random.Random(3)
    filler = "line 1 of 20 took 3 ms and " + "nothing else was said about it here " * 12
    values = {"email": "a.b@mail.example.com", "ip": "10.1.2.3", "card": card(rng), "phone": "+1 (375) 555-4393"}
    rows = [(i, filler * 8 + str(i)) for i in range(600)]
    rows += [(1000 + 10 * k + i, f"{i} {filler * 8}call {v} now for dump {i}") for k, v in enumerate(values.values()) for i in range(3)]
    rows += [(2000 + i, f"mail x{i}@mail.example.com") for i in range(100)]
    labelled = P.labelled_by_patterns(spark.createDataFrame(rows, "dump_id long, content string").repartition(4), most=12)
    kinds = [kind for _, spans in labelled for kind, _, _ in spans]
    assert all(kinds.count(kind) >= 3 for kind in values) and sum(bool(spans) for _, spans in labelled) == 12
