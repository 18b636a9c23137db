"""Language of dumps by string kernels.

Two texts are alike as far as they hold the same runs of one, two and three
characters within and at the ends of their words (the blended spectrum, by
presence): for each length the number of common runs over the root of the
product of both numbers, and the mean over the lengths. The kernel of a text
with some landmark texts stands for the text (Nyström); one ridge regression
per language against the rest is fitted in that space. As the project's records
do not name their language, the language of known dumps comes as a column.

Runs that no landmark holds add nothing to any inner product here; they are
left out of a text's norm too. So the kernel with all landmarks, times the
regression's weights, is a product of the batch's presence matrix with one
small matrix per length: a batch of texts costs a few matrix products.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetvitals.llm.storage import stored
from fleetvitals.llm.words import pieces

# The model is fitted on so many labelled dumps at most, shared out evenly among the languages, those of the
# smallest hash first; so many of them are landmarks.
MAX_LABELLED, LANDMARKS = 4_000, 192
LENGTHS = (1, 2, 3)
# Characters have a class of their own if they are among the most widespread of the landmarks; all others share one.
CLASSES = 256
RIDGE = 1e-3
UNDETERMINED = "und"
ROWS = 128  # texts of one presence matrix

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Per code point: is it a letter or a mark on one? Computed once per worker."""
    if not _letters:
        _letters.append(np.array([unicodedata.category(chr(i))[0] in "LM" for i in range(0x110000)]))
    return _letters[0]


def code_points(text: str | None) -> np.ndarray:
    """The text's letters in lower case, as code points; each run of anything else is one 0, also before and after."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    points = np.where(letters()[points], points, 0)
    points = np.concatenate(([0], points, [0]))
    return points[np.concatenate(([True], (points[1:] != 0) | (points[:-1] != 0)))]


class Spectrum:
    """The runs that the landmarks hold: classes of characters, and a column for each run."""

    def __init__(self, landmarks: list[str]):
        held: dict[int, int] = {}
        texts = [code_points(t) for t in landmarks]
        for points in texts:
            for p in np.unique(points[points > 0]).tolist():
                held[p] = held.get(p, 0) + 1
        own = sorted(held, key=lambda p: (-held[p], p))[: CLASSES - 2]
        self.base = len(own) + 2  # classes: a blank, all other characters, and those of their own
        self.class_of = np.ones(0x110000, dtype=np.uint8)
        self.class_of[0] = 0
        self.class_of[own] = np.arange(2, self.base)
        each = [self.class_of[p] for p in texts]
        self.runs = tuple(np.unique(np.concatenate([np.zeros(0, np.int64), *(_runs(e, n, self.base) for e in each)])) for n in LENGTHS)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "columns"}

    @functools.cached_property
    def columns(self) -> list[np.ndarray]:
        """Per length: run -> column, or -1. Made where it is used, as it is larger than the runs."""
        tables = []
        for n, runs in zip(LENGTHS, self.runs, strict=True):
            table = np.full(self.base**n, -1, dtype=np.int32)
            table[runs] = np.arange(len(runs))
            tables.append(table)
        return tables

    def presence(self, texts: list[str | None]) -> list[np.ndarray]:
        """Per length a matrix, texts x runs: 1 / root of the text's number of runs where it holds the run, else 0."""
        each = [self.class_of[code_points(t)] for t in texts]
        owner = np.repeat(np.arange(len(each)), [len(e) for e in each])
        classes = np.concatenate([np.zeros(0, np.uint8), *each])
        out = []
        for n, table, runs in zip(LENGTHS, self.columns, self.runs, strict=True):
            matrix = np.zeros((len(each), len(runs)), dtype=np.float32)
            # A run over the border of two texts has two blanks side by side, which no text has within.
            column = table[_runs(classes, n, self.base)]
            known = column >= 0
            matrix[owner[: len(column)][known], column[known]] = 1
            norm = np.sqrt(matrix.sum(axis=1, keepdims=True))
            out.append(np.divide(matrix, norm, out=matrix, where=norm > 0))
        return out


def _runs(classes: np.ndarray, n: int, base: int) -> np.ndarray:
    """The runs of n classes, each as a number."""
    out = np.zeros(max(len(classes) - n + 1, 0), dtype=np.int64)
    for k in range(n):
        out = out * base + classes[k : k + len(out)]
    return out


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    spectrum: Spectrum | None
    weights: tuple[np.ndarray, ...]  # per length: runs x languages

    def decide(self, texts: list[str | None]) -> np.ndarray:
        """Texts x languages: about 1 for the language of the text and -1 for the others."""
        out = np.zeros((len(texts), len(self.languages)))
        for at in range(0, len(texts), ROWS):
            for matrix, weights in zip(self.spectrum.presence(texts[at : at + ROWS]), self.weights, strict=True):
                out[at : at + ROWS] += matrix @ weights
        return out


def kernel(spectrum: Spectrum, texts: list[str], landmarks: list[str]) -> np.ndarray:
    """Texts x landmarks."""
    of_landmarks = spectrum.presence(landmarks)
    rows = [
        sum(m @ o.T for m, o in zip(spectrum.presence(texts[at : at + ROWS]), of_landmarks, strict=True)) / len(LENGTHS)
        for at in range(0, len(texts), ROWS)
    ]
    return np.concatenate(rows).astype(np.float64) if rows else np.zeros((0, len(landmarks)))


def solve(
    known: list[str], similar: np.ndarray, spectrum: Spectrum, landmarks: list[str], ridge: float = RIDGE
) -> Model:
    """Ridge regression per language. known: each known text's language; similar: its kernel with the landmarks."""
    languages = tuple(sorted(set(known)))
    place = {language: i for i, language in enumerate(languages)}
    column = [place[language] for language in known]
    target = np.full((len(known), len(languages)), -1.0)
    target[np.arange(len(known)), column] = 1.0
    # Languages weigh alike, however many of the known texts are theirs.
    weight = (1 / np.bincount(column))[column]
    weight = weight / weight.sum()
    values, vectors = np.linalg.eigh(kernel(spectrum, landmarks, landmarks))
    kept = values > 1e-6 * max(values[-1], 1e-12)
    to_features = vectors[:, kept] / np.sqrt(values[kept])
    features = similar @ to_features
    normal = features.T @ (features * weight[:, None]) + ridge * np.eye(features.shape[1])
    dual = to_features @ np.linalg.solve(normal, features.T @ (target * weight[:, None]))
    weights = tuple((m.T @ dual / len(LENGTHS)).astype(np.float32) for m in spectrum.presence(landmarks))
    return Model(languages, spectrum, weights)


def fit(known: list[tuple[str, str]], n_landmarks: int = LANDMARKS) -> Model:
    """On (language, text) at hand, in the order in which landmarks are taken."""
    landmarks = [text for _, text in known[:n_landmarks]]
    spectrum = Spectrum(landmarks)
    return solve([language for language, _ in known], kernel(spectrum, [text for _, text in known], landmarks), spectrum, landmarks)


def labelled(dumps: DataFrame, language: str, dump_id: str = "dump_id", content: str = "content", most: int = MAX_LABELLED) -> DataFrame:
    """(turn, language, content): the dumps to learn from, `most` of them at the most.

    Within a language those of the smallest hash of id and content come first,
    and languages take turns, so rare ones have their share: a dump's turn is
    the share of hashes below its own, times the distinct dumps of its language
    (by sketch). Repeated rows count once. Dumps without a letter or a language are left out.
    """
    rows = dumps.select(
        F.col(language).cast("string").alias("language"), F.col(content).cast("string").alias("content"),
        F.xxhash64(F.col(dump_id).cast("string"), F.col(content).cast("string")).alias("hash"),
    ).where(F.col("language").isNotNull() & F.col("content").rlike("\\p{L}"))
    keys = rows.select("language", "hash")
    # Written first, so that the join knows how small the counts are and leaves the keys where they lie.
    counts = stored(keys.groupBy("language").agg(F.approx_count_distinct("hash").alias("n")), "languages")
    share = F.col("hash").bitwiseAND((1 << 52) - 1) / float(1 << 52)
    early = (
        keys.join(counts, "language")
        .withColumn("turn", share * F.col("n"))
        .where(F.col("turn") < 2.0 * most)  # about 2 * most of each language
        .select("turn", "language", "hash")
        .distinct()
    )
    first = early.orderBy("turn", "language", "hash").limit(most)
    # `most` rows of three values bound the broadcast.
    return rows.join(F.broadcast(first), ["language", "hash"]).dropDuplicates(["language", "hash"]).select("turn", "language", "content")


def train(
    dumps: DataFrame, language: str = "language", dump_id: str = "dump_id", content: str = "content",
    max_labelled: int = MAX_LABELLED, n_landmarks: int = LANDMARKS,
) -> Model:
    """Fits on labelled dumps; those without a language, or without a letter, are left out. None left: no languages."""
    rows = stored(labelled(dumps, language, dump_id, content, max_labelled), "labelled")
    order = ["turn", "language", "content"]
    landmarks = [r.content for r in rows.orderBy(*order).limit(n_landmarks).collect()]
    if not landmarks:
        return Model((), None, ())
    spectrum = Spectrum(landmarks)
    shared = dumps.sparkSession.sparkContext.broadcast((spectrum, landmarks))

    @F.arrow_udf("array<float>")
    def similar(contents: pa.Array) -> pa.Array:
        found = kernel(shared.value[0], contents.to_pylist(), shared.value[1]).astype(np.float32)
        offsets = np.arange(len(found) + 1, dtype=np.int32) * len(shared.value[1])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))

    # n_landmarks numbers of each labelled dump; their texts stay where they are.
    got = sorted(rows.select("turn", "language", similar("content").alias("similar")).collect())
    return solve([r.language for r in got], np.array([r.similar for r in got]), spectrum, landmarks)


def identify(dumps: DataFrame, model: Model, content: str = "content") -> DataFrame:
    """The rows with lang_pred and score; columns of these names are replaced.

    lang_pred is the language of the highest decision value, ties to the first
    by name; score is that value, -1 .. 1 brought to 0 .. 1. Null contents, those
    without a letter, and all if no language was learned: `und` with score 0.
    Contents are read whole, however long. Repeated rows are judged each; an
    empty table gives an empty table.
    """
    shared = dumps.sparkSession.sparkContext.broadcast(model)

    def work(texts: pa.Array) -> tuple[list[str], np.ndarray]:
        decided = shared.value.decide(texts.to_pylist())
        best = decided.argmax(axis=1)
        score = np.clip((decided[np.arange(len(best)), best] + 1) / 2, 0, 1)
        return [shared.value.languages[i] for i in best.tolist()], score

    @F.arrow_udf("struct<lang_pred string, score double>")
    def predict(contents: pa.Array) -> pa.Array:
        named: list[str] = []
        scores = [np.zeros(0)]
        batch = pa.RecordBatch.from_arrays([contents], names=["content"])
        for piece in pieces(batch, "content"):
            languages, score = work(piece.column(0))
            named += languages
            scores.append(score)
        return pa.StructArray.from_arrays([pa.array(named, pa.string()), pa.array(np.concatenate(scores))], names=["lang_pred", "score"])

    text = F.col(content).cast("string")
    has_letter: Column = F.coalesce(text.rlike("\\p{L}"), F.lit(False))
    unknown = F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    kept = [c for c in dumps.columns if c not in ("lang_pred", "score")]
    given = {c: f"c{i}" for i, c in enumerate(kept)}
    found = F.when(has_letter, predict(text)).otherwise(unknown) if model.languages else unknown
    rows = dumps.select(*[F.col(f"`{c}`").alias(a) for c, a in given.items()], found.alias("found"))
    return rows.select(*[F.col(a).alias(c) for c, a in given.items()], "found.lang_pred", "found.score")
