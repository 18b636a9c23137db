import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetvitals.llm import language as L
from fleetvitals.llm import queries

WORDS = {
    "one": "the of and with node replica delay table index query slow buffer".split(),
    "two": "der die und mit knoten verzögerung tabelle abfrage langsam speicher größe".split(),
    "three": "узел задержка таблица запрос медленный буфер индекс сервер".split(),
    "四": "节点 延迟 数据库 查询 缓冲 索引 服务器 主从".split(),
}
RNG = random.Random(3)
KNOWN = [(lang, " ".join(RNG.choices(words, k=RNG.randrange(3, 40)))) for _ in range(40) for lang, words in WORDS.items()]


@pytest.fixture(scope="module")
def model(spark):
    dumps = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(KNOWN)], "dump_id long, content string, language string")
    return L.train(dumps, n_landmarks=50)


def runs(text, n):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    padded = " " + " ".join(letters.split()) + " " if letters.split() else " "
    return {padded[i : i + n] for i in range(len(padded) - n + 1)}


def test_kernel_is_that_of_the_definition():
    landmarks = [t for _, t in KNOWN[:12]]
    texts = [t for _, t in KNOWN[12:30]] + ["", "123", "Ein Wort, the NODE!"]
    held = [set().union(*(runs(t, n) for t in landmarks)) for n in L.LENGTHS]
    found = L.kernel(L.Spectrum(landmarks), texts, landmarks)
    for i, text in enumerate(texts):
        for j, landmark in enumerate(landmarks):
            wanted = 0.0
            for n, all_runs in zip(L.LENGTHS, held, strict=True):
                x, y = runs(text, n) & all_runs, runs(landmark, n)
                wanted += len(x & y) / (len(x) * len(y)) ** 0.5 / len(L.LENGTHS) if x else 0
            assert found[i, j] == pytest.approx(wanted, abs=1e-5)


def test_decisions_are_kernel_times_dual_weights(model):
    """Folding the weights into the presence matrices gives what ridge regression on the kernel gives."""
    landmarks = [t for _, t in KNOWN[:20]]
    fitted = L.fit(KNOWN, n_landmarks=20)
    spectrum = L.Spectrum(landmarks)
    similar, among = L.kernel(spectrum, [t for _, t in KNOWN], landmarks), L.kernel(spectrum, landmarks, landmarks)
    languages = sorted(WORDS)
    target = np.array([[1.0 if lang == x else -1.0 for x in languages] for lang, _ in KNOWN])
    weight = np.full(len(KNOWN), 1 / len(KNOWN))  # the same number of texts of each
    values, vectors = np.linalg.eigh(among)
    kept = values > 1e-6 * values[-1]
    root = vectors[:, kept] / np.sqrt(values[kept])
    features = similar @ root
    solved = np.linalg.solve(features.T @ (features * weight[:, None]) + L.RIDGE * np.eye(kept.sum()), features.T @ (target * weight[:, None]))
    assert np.allclose(fitted.decide([t for _, t in KNOWN]), features @ solved, atol=1e-3)


def test_held_out_texts(spark, model):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(WORDS[lang], k=rng.randrange(2, 60))), lang) for i, lang in enumerate(rng.choices(sorted(WORDS), k=300))]
    found = L.identify(spark.createDataFrame(rows, "dump_id long, content string, wanted string"), model).collect()
    assert sum(r.lang_pred == r.wanted for r in found) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in found)


def test_given_table_held_out(spark):
    sf = "/root/testdata/sf0.01"
    documents = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.op12_language_id(spark, sf).collect()
    assert len(found) == len(documents)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    held_out = [r for r in found if r.held_out and documents[r.doc_id].lang]
    assert sum(r.lang_pred == documents[r.doc_id].lang for r in held_out) >= 0.98 * len(held_out)
    languages = {d.lang for d in documents.values() if d.lang}
    for r in found:
        text = documents[r.doc_id].text
        assert (r.lang_pred in languages) == bool(text and any(c.isalpha() for c in text))


def test_odd_rows(spark, odd, nothing, model):
    given = odd.withColumns({c: F.lit("x") for c in ("found", "c0", "hash", "language", "turn", "share", "lang_pred")})
    found = L.identify(given, model)
    assert found.count() == odd.count() and set(given.columns) <= set(found.columns)
    for r in found.collect():
        assert (r.lang_pred == "und" and r.score == 0) == (not any(c.isalpha() for c in r.content or ""))
    assert L.identify(nothing, model).count() == 0
    none = L.train(nothing.withColumn("language", F.lit("x")))
    assert {r.lang_pred for r in L.identify(odd, none).collect()} == {"und"}
    only = L.train(odd.withColumn("language", F.lit("x")))
    assert {r.lang_pred for r in L.identify(odd, only).collect()} == {"und", "x"}


def test_labelled_shares_and_bound(spark):
    rows = [(i, f"text number {i} of it", "common") for i in range(2000)] + [(i, f"other {i}", "rare") for i in range(30)]
    rows += [(5000, "again", "repeated")] * 500 + [(1, "known but nameless", None), (2, None, "rare"), (3, "17 %", "rare")]
    given = spark.createDataFrame(rows, "dump_id long, content string, language string").repartition(4)
    found = L.labelled(given, "language", most=100).collect()
    counts = {lang: sum(r.language == lang for r in found) for lang in ("common", "rare", "repeated")}
    assert len(found) == 100 and counts["rare"] == 30 and counts["repeated"] == 1 and counts["common"] == 69
    assert sorted(map(tuple, found)) == sorted(map(tuple, L.labelled(given.repartition(7), "language", most=100).collect()))


def test_very_long_text_counts_whole(model):
    """What stands at the end of a long text counts as much as what stands at its start."""
    text = "1 " * 500_000 + " ".join(WORDS["two"] * 20)
    assert model.languages[model.decide([text])[0].argmax()] == "two"
