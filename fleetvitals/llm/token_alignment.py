"""Alignment of two tokenizers over dumps, and how often their tokens end together.

A teacher and a student model cut the same dump into different tokens. Where
both cut, the text before is a group: some tokens of one, some of the other,
equal bytes. The two tokens that end there are linked. How often a pair is
linked over all dumps says which token of A stands for a token of B.

Each dump goes through the tokenizers once; its ids are written to the shared
folder, and both passes align those. Pairs are counted in dense vectors: every
task counts the pairs it meets; the distinct pairs get a minimal perfect hash;
each task's counts become a vector indexed by it, and the vectors are summed as
a tree. A second pass aligns the ids again and looks the counts up, comparing
each key with the one kept.

Of two tokens that end at the same byte the shorter is a suffix of the longer.
So the pairs are no more than the bytes of both vocabularies (times the ids that
share their bytes), whatever the number of dumps: Vocabularies.max_pairs. That
bounds the keys in the driver, the broadcast index and every count vector.

A: byte-level BPE, a JSON file with vocabulary and merges. B: a SentencePiece
model. Both files lie at the same path for the driver and all executors.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetvitals.llm.perfect_hash import PerfectHash
from fleetvitals.llm.storage import discard, stored
from fleetvitals.llm.words import binary_of, pieces

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
# Fixed value: how byte-level BPE splits a text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FAN_IN = 16  # vectors summed by one task
PENDING = 1 << 20  # pairs that a task gathers before it sums them up


def _byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones as themselves, the others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Spelling:
    """Byte strings by number, to be written out for many numbers at once."""

    def __init__(self, strings: list[bytes]):
        self.lengths = np.array([len(s) for s in strings], dtype=np.int64)
        self._starts = np.cumsum(self.lengths) - self.lengths
        self._data = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def write(self, numbers: np.ndarray) -> np.ndarray:
        """The bytes of all numbers' strings, one after the other."""
        lengths = self.lengths[numbers]
        at = np.repeat(self._starts[numbers] - (np.cumsum(lengths) - lengths), lengths)
        return self._data[at + np.arange(len(at))]


class Vocabularies:
    """Both tokenizers, and the bytes of every token."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        import sentencepiece
        import tiktoken

        with open(byte_bpe, encoding="utf-8") as f:
            given = json.load(f)
        special = {t["content"] for t in given["added_tokens"]}
        byte_of = _byte_alphabet()
        ranks = {bytes(byte_of[c] for c in t): i for t, i in given["model"]["vocab"].items() if t not in special}
        # The merges of such a file stand in the order of the ids, so ranks encode as merges do.
        self._a = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(given["model"]["vocab"].values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self._b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        self.b_bytes = [
            bytes([int(self._b.id_to_piece(i)[3:5], 16)]) if self._b.is_byte(i) else self._b.id_to_piece(i).replace("▁", " ").encode()
            for i in range(self._b.get_piece_size())
        ]
        self.a, self.b = Spelling(self.a_bytes), Spelling(self.b_bytes)
        # How ids are written between the passes.
        self.id_type = np.dtype("<u2" if max(len(self.a_bytes), len(self.b_bytes)) <= 1 << 16 else "<u4")
        # How groups are written: ids with what may follow them.
        a, b = len(self.a_bytes), len(self.b_bytes)
        written = [*(f"{i}," for i in range(a)), *(f"{i}|" for i in range(a)), *(f"{i}," for i in range(b)), *(f"{i};" for i in range(b))]
        self.written = Spelling([w.encode() for w in written])

    @property
    def max_pairs(self) -> int:
        """A bound on the distinct links: each is a token and one of its suffixes, in either vocabulary."""
        most = [max(Counter(t for t in tokens if t).values()) for tokens in (self.a_bytes, self.b_bytes)]
        return int(most[1] * self.a.lengths.sum() + most[0] * self.b.lengths.sum())

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A over a space and the text, and of B over the text."""
        return self._a.encode_to_numpy(" " + text), np.array(self._b.encode(text), dtype=np.int64)


_loaded: dict[tuple[str, str], Vocabularies] = {}


def vocabularies(byte_bpe: str, piece_bpe: str) -> Vocabularies:
    """One copy per worker."""
    key = (byte_bpe, piece_bpe)
    if key not in _loaded:
        _loaded[key] = Vocabularies(*key)
    return _loaded[key]


@dataclass
class Alignment:
    """Some texts' tokens, one after the other, and which of them end where one of the other tokenizer ends."""

    a: np.ndarray
    b: np.ndarray
    a_counts: np.ndarray
    b_counts: np.ndarray
    a_ends: np.ndarray  # of each token: does one of the other's end with it?
    b_ends: np.ndarray

    @property
    def links(self) -> np.ndarray:
        """Linked pairs in text order, as a << 32 | b."""
        return (self.a[self.a_ends] << 32) | self.b[self.b_ends]

    def link_bounds(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.a_ends)))[np.concatenate(([0], np.cumsum(self.a_counts)))]

    def groups(self, known: Vocabularies) -> pa.Array:
        """Per text `a1,a2|b1;a3|b2,b3`."""
        n_a, n_b = len(known.a_bytes), len(known.b_bytes)
        before_a = np.cumsum(self.a_ends) - self.a_ends  # groups before each token
        before_b = np.cumsum(self.b_ends) - self.b_ends
        b_until = np.concatenate(([0], np.flatnonzero(self.b_ends) + 1))
        a_until = np.concatenate(([0], np.flatnonzero(self.a_ends) + 1))
        order = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        order[np.arange(len(self.a)) + b_until[before_a]] = self.a + n_a * self.a_ends
        order[np.arange(len(self.b)) + a_until[before_b + 1]] = 2 * n_a + self.b + n_b * self.b_ends
        data, ends = known.written.write(order), np.cumsum(known.written.lengths[order])
        # The last byte of a text is the mark after its last group, which is left out.
        last = np.cumsum(self.a_counts + self.b_counts)
        offsets = np.concatenate(([0], np.concatenate(([0], ends))[last]))
        some = np.diff(offsets) > 0
        kept = np.ones(len(data), dtype=bool)
        kept[offsets[1:][some] - 1] = False
        offsets = offsets - np.concatenate(([0], np.cumsum(some)))
        return pa.LargeStringArray.from_buffers(len(last), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[kept]))


@dataclass
class Tokens:
    """Some texts' ids, one text after the other, and how many each has of both tokenizers."""

    a: np.ndarray
    b: np.ndarray
    a_counts: np.ndarray
    b_counts: np.ndarray


def tokenize(texts: list[str | None], known: Vocabularies) -> Tokens:
    """Null and empty texts, and those that A or B does not give back byte by byte, have no tokens."""
    encoded = [known.encode(t) if t else (np.zeros(0, np.int64), np.zeros(0, np.int64)) for t in texts]
    data = [(" " + t).encode() if t else b"" for t in texts]
    a, b = (np.concatenate([np.zeros(0, np.int64), *(e[side] for e in encoded)]) for side in (0, 1))
    a_counts, b_counts = (np.array([len(e[side]) for e in encoded], dtype=np.int64) for side in (0, 1))
    sizes = np.array([len(d) for d in data], dtype=np.int64)

    def per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(values)))[np.concatenate(([0], np.cumsum(counts)))])

    def only(whole: np.ndarray) -> None:
        nonlocal a, b, a_counts, b_counts, sizes
        if not whole.all():
            a, b = a[np.repeat(whole, a_counts)], b[np.repeat(whole, b_counts)]
            a_counts, b_counts, sizes = (np.where(whole, x, 0) for x in (a_counts, b_counts, sizes))

    only((per_text(known.a.lengths[a], a_counts) == sizes) & (per_text(known.b.lengths[b], b_counts) == sizes))
    text_bytes = np.frombuffer(b"".join(d for d, n in zip(data, sizes.tolist(), strict=True) if n), dtype=np.uint8)
    only(per_text((known.a.write(a) != text_bytes) | (known.b.write(b) != text_bytes), sizes) == 0)
    return Tokens(a, b, a_counts, b_counts)


def align_ids(tokens: Tokens, known: Vocabularies) -> Alignment:
    a, b = tokens.a, tokens.b
    # Texts lie end to end; as both have the bytes of the text, each starts at the same place for both.
    a_at, b_at = np.cumsum(known.a.lengths[a]), np.cumsum(known.b.lengths[b])
    size = int(a_at[-1]) + 1 if len(a) else 1
    in_a, in_b = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
    in_a[a_at], in_b[b_at] = True, True
    return Alignment(a, b, tokens.a_counts, tokens.b_counts, in_b[a_at], in_a[b_at])


def align(texts: list[str | None], known: Vocabularies) -> Alignment:
    return align_ids(tokenize(texts, known), known)


def _to_binary(ids: np.ndarray, counts: np.ndarray, id_type: np.dtype) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(counts))) * id_type.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids.astype(id_type))])


def _from_binary(column: pa.Array, id_type: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    data, bounds = binary_of(column)
    return data[bounds[0] : bounds[-1]].view(id_type).astype(np.int64), np.diff(bounds) // id_type.itemsize


def _aligned(batch: pa.RecordBatch, known: Vocabularies) -> Iterator[tuple[pa.RecordBatch, Alignment]]:
    """Pieces of a batch of stored ids, and what they align to."""
    for piece in pieces(batch, "a"):
        (a, a_counts), (b, b_counts) = (_from_binary(piece.column(c), known.id_type) for c in ("a", "b"))
        yield piece, align_ids(Tokens(a, b, a_counts, b_counts), known)


def stored_ids(dumps: DataFrame, byte_bpe: str, piece_bpe: str) -> DataFrame:
    """(id, a, b) of dumps (id, content): the ids of both tokenizers, written to the shared folder. Rows as given, repeats too."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabularies(byte_bpe, piece_bpe)
        for batch in batches:
            for piece in pieces(batch, "content"):
                found = tokenize(piece.column("content").to_pylist(), known)
                ids = [_to_binary(found.a, found.a_counts, known.id_type), _to_binary(found.b, found.b_counts, known.id_type)]
                yield pa.RecordBatch.from_arrays([piece.column("id"), *ids], names=["id", "a", "b"])

    return stored(dumps.mapInArrow(work, "id long, a binary, b binary"), "token-ids")


def _sum_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    out = np.zeros(len(distinct), dtype=np.int64)
    np.add.at(out, place, np.concatenate(counts))
    return distinct, out


@dataclass
class PairIndex:
    """Count of every linked pair, by its perfect hash; keys are kept to compare with."""

    hashed: PerfectHash
    keys: np.ndarray
    counts: np.ndarray

    def place(self, pairs: np.ndarray) -> np.ndarray:
        at = self.hashed.index(pairs)
        if len(pairs) and ((at < 0).any() or (self.keys[at] != pairs).any()):
            raise KeyError("a pair that the first pass did not meet: the dumps or the vocabularies have changed between the passes")
        return at

    def best_of_b(self, size: int) -> np.ndarray:
        """Per id of B its highest count."""
        best = np.zeros(size, dtype=np.int64)
        np.maximum.at(best, self.keys & 0xFFFFFFFF, self.counts)
        return best


def _tree_sum(vectors: DataFrame, size: int) -> np.ndarray:
    """Sum of vectors (part, counts), FAN_IN of them by a task at a time until one is left."""

    def add(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        total = np.zeros(size, dtype=np.int64)
        for vector in group.column("counts"):
            total += np.frombuffer(vector.as_buffer(), dtype=np.int64)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})

    def highest() -> int | None:
        return vectors.agg(F.max("part")).first()[0]

    while highest():
        grouped = vectors.select(F.expr(f"part div {FAN_IN}").alias("part"), "counts").groupBy("part")
        last, vectors = vectors, stored(grouped.applyInArrow(add, "part long, counts binary"), "pair-counts")
        discard(last)
    found = vectors.first()
    discard(vectors)
    return np.zeros(size, dtype=np.int64) if found is None else np.frombuffer(found.counts, dtype=np.int64)


def count_pairs(dumps: DataFrame, content: str = "content", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> PairIndex:
    """How often each pair of ids is linked in all dumps. Repeated rows count each."""
    rows = dumps.select(F.lit(None).cast("long").alias("id"), F.col(content).cast("string").alias("content"))
    ids = stored_ids(rows, byte_bpe, piece_bpe)
    index = _count(ids, byte_bpe, piece_bpe)
    discard(ids)
    return index


def _count(ids: DataFrame, byte_bpe: str, piece_bpe: str) -> PairIndex:
    """First pass over stored ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabularies(byte_bpe, piece_bpe)
        keys: list[np.ndarray] = [np.zeros(0, np.int64)]
        counts: list[np.ndarray] = [np.zeros(0, np.int64)]
        for batch in batches:
            for _, found in _aligned(batch, known):
                met, n = np.unique(found.links, return_counts=True)
                keys.append(met)
                counts.append(n)
                if sum(map(len, keys[1:])) > PENDING:
                    k, c = _sum_up(keys, counts)
                    keys, counts = [k], [c]
        k, c = _sum_up(keys, counts)
        if len(k):
            part = pa.array([TaskContext.get().partitionId()], pa.int64())
            yield pa.RecordBatch.from_arrays([part, pa.array([k.tolist()], pa.list_(pa.int64())), pa.array([c.tobytes()], pa.binary())], names=["part", "pairs", "counts"])

    met = stored(ids.select("a", "b").mapInArrow(work, "part long, pairs array<long>, counts binary"), "pairs")
    # Vocabularies.max_pairs bounds these, at every number of dumps.
    keys = np.array(sorted(r[0] for r in met.select(F.explode("pairs")).distinct().collect()), dtype=np.int64)
    hashed = PerfectHash(keys)
    kept = np.empty_like(keys)
    kept[hashed.index(keys)] = keys
    index = PairIndex(hashed, kept, np.zeros(len(keys), np.int64))
    shared = ids.sparkSession.sparkContext.broadcast(index)

    def to_vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                vector = np.zeros(len(shared.value.keys), dtype=np.int64)
                pairs = batch.column(1)[i].values.to_numpy()
                vector[shared.value.place(pairs)] = np.frombuffer(batch.column(2)[i].as_buffer(), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([vector.tobytes()], pa.binary())], names=["part", "counts"])

    vectors = stored(met.mapInArrow(to_vector, "part long, counts binary"), "pair-counts")
    discard(met)
    return PairIndex(hashed, kept, _tree_sum(vectors, len(keys)))


def align_tokens(
    dumps: DataFrame, dump_id: str = "dump_id", content: str = "content", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE
) -> DataFrame:
    """Per row: dump_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups.

    n_a and n_b are the tokens of A (over a space and the content) and of B
    (which adds that space itself). groups writes the groups as
    `a1,a2|b1;a3|b2,b3`, decimal ids in order. A link is a token of A and one of
    B that end at the same byte. count_sum adds up, over the links, how often
    their pair is linked in all dumps; n_best counts the links whose pair is
    linked as often as any pair of that id of B, ties included.

    Null and empty contents have no tokens, nor have those that either
    tokenizer does not give back byte by byte (a content that holds U+2581, for
    one): zeros and an empty string. Special tokens' names in a content are
    plain text. Contents are read whole, however long; repeated rows count each;
    other columns of any name do not matter; an empty table gives none. Rows
    without an id are kept.
    """
    rows = dumps.select(F.col(dump_id).cast("long").alias("id"), F.col(content).cast("string").alias("content"))
    ids = stored_ids(rows, byte_bpe, piece_bpe)
    index = _count(ids, byte_bpe, piece_bpe)
    shared = dumps.sparkSession.sparkContext.broadcast(index)
    figures = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, index = vocabularies(byte_bpe, piece_bpe), shared.value
        best = index.best_of_b(len(known.b_bytes))
        for batch in batches:
            for piece, found in _aligned(batch, known):
                links, bounds = found.links, found.link_bounds()
                counts = index.counts[index.place(links)]
                is_best = counts == best[links & 0xFFFFFFFF]

                def per_text(values: np.ndarray) -> np.ndarray:
                    return np.diff(np.concatenate(([0], np.cumsum(values)))[bounds])  # noqa: B023 called at once

                n_links = np.diff(bounds)
                columns = (found.a_counts, found.b_counts, n_links, n_links, per_text(is_best), per_text(counts))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), *(pa.array(c, pa.int64()) for c in columns), found.groups(known).cast(pa.string())],
                    names=["id", *figures, "groups"],
                )

    schema = "id long, " + ", ".join(f"{c} long" for c in figures) + ", groups string"
    return ids.mapInArrow(work, schema).withColumnRenamed("id", dump_id)
