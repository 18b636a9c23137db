import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetvitals.llm import queries
from fleetvitals.llm import token_alignment as A
from fleetvitals.llm.perfect_hash import PerfectHash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    """Both tokenizers by their own libraries, and a slow alignment of one text: (a, b, groups, links)."""
    first = Tokenizer.from_file(A.BYTE_BPE)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=A.PIECE_BPE)
    byte_of = A._byte_alphabet()

    def ends(tokens):
        at, out = 0, []
        for t in tokens:
            at += len(t)
            out.append(at)
        return out

    def one(text):
        if not text:
            return [], [], [], []
        a = first.encode(" " + text, add_special_tokens=False)
        b = second.encode(text)
        a_tokens = [bytes(byte_of[c] for c in t) for t in a.tokens]
        b_tokens = []
        for i in b:
            piece = second.id_to_piece(i)
            b_tokens.append(bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode())
        data = (" " + text).encode()
        if b"".join(a_tokens) != data or b"".join(b_tokens) != data:
            return [], [], [], []
        a_ends, b_ends = ends(a_tokens), ends(b_tokens)
        groups, links, start = [], [], 0
        for end in sorted(set(a_ends) & set(b_ends)):
            groups.append(([i for i, e in zip(a.ids, a_ends, strict=True) if start < e <= end], [i for i, e in zip(b, b_ends, strict=True) if start < e <= end]))
            links.append((a.ids[a_ends.index(end)], b[b_ends.index(end)]))
            start = end
        return a.ids, b, groups, links

    return one


def expected(texts, plain):
    found = [plain(t) for t in texts]
    counts = Counter(link for *_, links in found for link in links)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for a, b, groups, links in found:
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        n_best = sum(counts[link] == best[link[1]] for link in links)
        out.append((len(a), len(b), len(groups), len(links), n_best, sum(counts[link] for link in links), written))
    return out


ODD_TEXTS = [
    None, "", " ", "\n", "a", "plain text, twice. plain text, twice.", "▁ is a blank there", "<s> </s> <unk> <|endoftext|> <0x41>",
    "  two  blanks ", "tab\tnew\r\nline\x00nul", "Ünïcödé ß 中文字 ελληνικά русский 🙂👩‍👩‍👧", "é    x​", "don't we'll I'VE", "1234567890 12,5 %",
    "x" * 5000, "ab " * 4000, "﻿bom �", "plain text, twice. plain text, twice.",
]


def test_odd_texts_against_the_libraries(spark, plain):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "no id")]
    given = spark.createDataFrame(rows, "dump_id long, content string").repartition(5)
    given = given.withColumns({c: F.lit(7) for c in ("id", "groups", "n_a", "part", "pairs", "counts")})
    found = {r.dump_id: tuple(r)[1:] for r in A.align_tokens(given).collect()}
    for (i, _), e in zip(rows, expected([t for _, t in rows], plain), strict=True):
        assert found[i] == e, i
    assert found[6] == (0, 0, 0, 0, 0, 0, "") and found[7][0] > 0


def test_whole_table(spark, plain):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    wanted = dict(zip(docs, expected(docs.values(), plain), strict=True))
    found = queries.op11_cross_tokenizer_alignment(spark, SF).collect()
    assert len(found) == len(docs)
    for r in found:
        *numbers, groups = wanted[r.doc_id]
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == (*numbers, digest)


def test_parts_are_summed_as_a_tree(spark, monkeypatch):
    monkeypatch.setattr(A, "FAN_IN", 2)
    texts = [f"node {i % 7} reports slow queries" for i in range(40)]
    for parts in (1, 5, 9):
        index = A.count_pairs(spark.createDataFrame([(t,) for t in texts], "content string").repartition(parts))
        links = np.concatenate([A.align([t], A.vocabularies(A.BYTE_BPE, A.PIECE_BPE)).links for t in texts])
        keys, counts = np.unique(links, return_counts=True)
        assert index.counts[index.place(keys)].tolist() == counts.tolist() and len(index.keys) == len(keys)


def test_pairs_are_bounded_by_the_vocabularies(spark):
    """Of two tokens that end together one is a suffix of the other."""
    known = A.vocabularies(A.BYTE_BPE, A.PIECE_BPE)
    index = A.count_pairs(spark.read.parquet(f"{SF}/documents.parquet"), content="text")
    assert len(index.keys) < known.max_pairs < 2_000_000
    for key in index.keys.tolist():
        a, b = known.a_bytes[key >> 32], known.b_bytes[key & 0xFFFFFFFF]
        assert a.endswith(b) or b.endswith(a)


def test_an_unknown_pair_is_an_error(spark):
    index = A.count_pairs(spark.createDataFrame([("some words",)], "content string"))
    with pytest.raises(KeyError):
        index.place(np.array([1 << 40 | 5]))


def test_nothing(spark, nothing, odd):
    assert A.align_tokens(nothing).count() == 0
    found = A.align_tokens(odd)
    assert found.count() == odd.count() and found.where("content is not null").count() if "content" in found.columns else True


def test_very_long_text(spark, plain):
    text = "the node wrote 17 slow queries; " * 40_000
    r = A.align_tokens(spark.createDataFrame([(1, text)], "dump_id long, content string")).first()
    known = A.vocabularies(A.BYTE_BPE, A.PIECE_BPE)
    assert r.n_groups == r.groups.count("|") == r.n_links and r.n_a == len(known._a.encode_ordinary(" " + text))


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 1000, 50_000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).choice(1 << 62, n, replace=False).astype(np.int64)
    hashed = PerfectHash(keys)
    assert sorted(hashed.index(keys).tolist()) == list(range(n))
    assert sum(len(w) * 8 for _, w, _ in hashed.levels) <= max(n, 64) + 8 * 200
    with pytest.raises(ValueError, match="distinct"):
        PerfectHash(np.array([3, 3]))


def test_dumps_go_through_the_tokenizers_once(spark, plain, tmp_path):
    """What is left to compute reads the stored ids, not the contents."""
    texts = ["plain text, twice. plain text, twice.", None, "", "▁ no", "Ünïcödé 中文字 🙂", "plain text"]
    spark.createDataFrame(list(enumerate(texts)), "dump_id long, content string").write.parquet(f"{tmp_path}/dumps.parquet")
    found = A.align_tokens(spark.read.parquet(f"{tmp_path}/dumps.parquet"))
    assert found.inputFiles() and not any("dumps.parquet" in f for f in found.inputFiles())
    assert {r.dump_id: tuple(r)[1:] for r in found.collect()} == dict(enumerate(expected(texts, plain)))
