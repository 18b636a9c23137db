"""Personal data in dumps: fixed patterns, and a character model that adds to them.

Dumps carry accounts, addresses and statement texts with literals. Patterns
find what is well formed. A bidirectional LSTM over characters, with a CRF over
its tags, is trained in numpy from labelled spans and adds what they miss. It
reads overlapping windows around digits and at-signs (every kind of span holds
one); the windows' spans are reconciled over the whole text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind

# Windows for training, of as many labelled dumps at most, those of the smallest id hash.
MAX_LABELLED = 400
WINDOW, STRIDE, MARGIN = 96, 48, 40
EMBED, HIDDEN = 10, 14

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local@domain.label, found from each at-sign so that long runs cost no more than their length."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
            low = found.end()
        at = text.find("@", max(at + 1, low))


def base_spans(text: str) -> list[Span]:
    """Well-formed spans by start, then kind; leftmost and non-overlapping per kind, failing matches dropped."""
    if not _TRIGGER.search(text):
        return []
    out = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _char_table() -> np.ndarray:
    """Numbers of characters below 256; all others share the last one."""
    table = np.full(256, 47)
    for i, c in enumerate("0123456789abcdefghijklmnopqrstuvwxyz"):
        table[ord(c)] = 1 + i
    table[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 37
    for i, c in enumerate("@.-_+%() "):
        table[ord(c)] = 38 + i
    return table


_CHARS, N_CHARS = _char_table(), 49  # 0 pads; the nine marks end at 46, other single bytes are 47, the rest 48


def encode(windows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.zeros((len(windows), WINDOW), dtype=np.int64)
    mask = np.zeros((len(windows), WINDOW), dtype=bool)
    for i, w in enumerate(windows):
        points = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes[i, : len(points)] = np.where(points < 256, _CHARS[np.minimum(points, 255)], 48)
        mask[i, : len(points)] = True
    return codes, mask


def window_starts(text: str) -> list[int]:
    """Starts of windows that cover all within MARGIN of a digit or at-sign; neighbours overlap by half."""
    starts: list[int] = []
    low = high = -1
    regions: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if low >= 0 and a <= high:
            high = max(high, b)
        else:
            if low >= 0:
                regions.append((low, high))
            low, high = a, b
    if low >= 0:
        regions.append((low, high))
    for low, high in regions:
        starts += range(low, max(low + 1, high - WINDOW + STRIDE), STRIDE)
    return starts


@dataclass
class Tagger:
    """BiLSTM-CRF weights: embedding, per direction input, recurrent and bias, output, and tag transitions."""

    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int = 0) -> Tagger:
        rng = np.random.default_rng(seed)
        p = {"E": rng.normal(0, 0.3, (N_CHARS, EMBED)), "V": rng.normal(0, 0.3, (2 * HIDDEN, TAGS)), "c": np.zeros(TAGS), "T": np.zeros((TAGS, TAGS))}
        for d in "fb":
            p[f"W{d}"] = rng.normal(0, 0.3, (EMBED, 4 * HIDDEN))
            p[f"U{d}"] = rng.normal(0, 0.3, (HIDDEN, 4 * HIDDEN))
            p[f"z{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        return cls(p)

    def _run(self, codes: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        p, n, steps = self.p, len(codes), range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1)
        inputs = (p["E"] @ p[f"W{d}"])[codes]
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        out, kept = np.zeros((n, WINDOW, HIDDEN)), [None] * WINDOW
        for t in steps:
            a = inputs[:, t] + h @ p[f"U{d}"] + p[f"z{d}"]
            gates = 1 / (1 + np.exp(-a[:, : 3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(a[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            c_new = np.where(m, f * c + i * g, c)
            s = np.tanh(c_new)
            h_new = np.where(m, o * s, h)
            kept[t] = (h, c, i, f, o, g, s)
            h, c = h_new, c_new
            out[:, t] = h
        return out, kept

    def emissions(self, codes: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        hf, kf = self._run(codes, mask, "f")
        hb, kb = self._run(codes, mask, "b")
        h = np.concatenate([hf, hb], axis=2)
        return h @ self.p["V"] + self.p["c"], (h, kf, kb)

    def gradients(self, codes: np.ndarray, mask: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tag sequences, and its gradient."""
        p, n = self.p, len(codes)
        e, (h, kf, kb) = self.emissions(codes, mask)
        alpha = np.zeros((n, WINDOW, TAGS))
        alpha[:, 0] = e[:, 0]
        for t in range(1, WINDOW):
            step = _logsumexp(alpha[:, t - 1, :, None] + p["T"][None], 1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
        z = _logsumexp(alpha[:, -1], 1)
        beta = np.zeros((n, WINDOW, TAGS))
        dT, de = np.zeros_like(p["T"]), np.zeros_like(e)
        for t in range(WINDOW - 1, -1, -1):
            if t + 1 < WINDOW:
                ahead = beta[:, t + 1] + e[:, t + 1]
                step = _logsumexp(p["T"][None] + ahead[:, None, :], 2)
                beta[:, t] = np.where(mask[:, t + 1, None], step, beta[:, t + 1])
                pair = np.exp(alpha[:, t, :, None] + p["T"][None] + ahead[:, None, :] - z[:, None, None])
                dT += (pair * mask[:, t + 1, None, None]).sum(0)
            de[:, t] = np.exp(alpha[:, t] + beta[:, t] - z[:, None]) * mask[:, t, None]
        rows = np.arange(n)[:, None]
        gold = (e[rows, np.arange(WINDOW)[None], tags] * mask).sum(1) + (p["T"][tags[:, :-1], tags[:, 1:]] * mask[:, 1:]).sum(1)
        de[rows, np.arange(WINDOW)[None], tags] -= mask
        np.add.at(dT, (tags[:, :-1][mask[:, 1:]], tags[:, 1:][mask[:, 1:]]), -1)
        de, dT = de / n, dT / n
        grad = {"T": dT, "c": de.sum((0, 1)), "V": h.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS), "E": np.zeros_like(p["E"])}
        dh = de @ p["V"].T
        for d, kept, part in (("f", kf, dh[:, :, :HIDDEN]), ("b", kb, dh[:, :, HIDDEN:])):
            self._back(codes, mask, d, kept, part, grad)
        return float((z - gold).mean()), grad

    def _back(self, codes, mask, d, kept, dh, grad) -> None:
        p, n = self.p, len(codes)
        U = p[f"U{d}"]
        dU, da_all = np.zeros_like(U), np.zeros((n, WINDOW, 4 * HIDDEN))
        h_next, c_next = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        for t in range(WINDOW - 1, -1, -1) if d == "f" else range(WINDOW):
            h0, c0, i, f, o, g, s = kept[t]
            m = mask[:, t, None]
            total = dh[:, t] + h_next
            dc = c_next + np.where(m, total * o * (1 - s * s), 0)
            da = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), total * s * o * (1 - o), dc * i * (1 - g * g)], axis=1) * m
            da_all[:, t] = da
            dU += h0.T @ da
            h_next = np.where(m, da @ U.T, total)
            c_next = np.where(m, dc * f, dc)
        flat = da_all.reshape(-1, 4 * HIDDEN)
        by_char = np.zeros((N_CHARS, 4 * HIDDEN))
        np.add.at(by_char, codes.ravel(), flat)
        grad[f"U{d}"], grad[f"z{d}"] = dU, flat.sum(0)
        grad[f"W{d}"] = p["E"].T @ by_char
        grad["E"] += by_char @ p[f"W{d}"].T

    def decode(self, windows: list[str]) -> list[list[tuple[str, int, int, float]]]:
        """Best spans per window: (kind, start, end, margin over leaving the span out, per character)."""
        codes, mask = encode(windows)
        e, _ = self.emissions(codes, mask)
        n, T = len(windows), self.p["T"]
        score, back = e[:, 0], np.zeros((n, WINDOW, TAGS), dtype=np.int8)
        for t in range(1, WINDOW):
            all_ = score[:, :, None] + T[None]
            best = all_.argmax(1)
            step = np.take_along_axis(all_, best[:, None, :], 1)[:, 0] + e[:, t]
            live = mask[:, t, None]
            back[:, t] = np.where(live, best, np.arange(TAGS)[None])
            score = np.where(live, step, score)
        path = np.zeros((n, WINDOW), dtype=np.int64)
        path[:, -1] = score.argmax(1)
        for t in range(WINDOW - 1, 0, -1):
            path[:, t - 1] = back[np.arange(n), t, path[:, t]]
        out = []
        for w in range(n):
            spans, t, length = [], 0, int(mask[w].sum())
            tags = path[w]
            while t < length:
                if tags[t] == 0:
                    t += 1
                    continue
                kind, start = (tags[t] - 1) // 2, t
                t += 1
                while t < length and tags[t] == 2 * kind + 2:
                    t += 1
                margin = float((e[w, np.arange(start, t), tags[start:t]] - e[w, start:t, 0]).mean())
                spans.append((KINDS[kind], start, t, margin))
            out.append(spans)
        return out


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def tag_window(start: int, length: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(WINDOW, dtype=np.int64)
    for kind, a, b in spans:
        low, high = max(a - start, 0), min(b - start, length)
        if low < high:
            tags[low:high] = 2 * KINDS.index(kind) + 2
            if a >= start:
                tags[low] = 2 * KINDS.index(kind) + 1
    return tags


def fit(examples: list[tuple[str, list[Span]]], epochs: int = 8, seed: int = 0) -> Tagger:
    """Trains on texts with their spans, in the order given; the same examples give the same weights."""
    windows, tags = [], []
    for text, spans in examples:
        for start in window_starts(text):
            w = text[start : start + WINDOW]
            windows.append(w)
            tags.append(tag_window(start, len(w), spans))
    tagger = Tagger.new(seed)
    if not windows:
        return tagger
    codes, mask = encode(windows)
    tags = np.array(tags)
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    v = {k: np.zeros_like(w) for k, w in tagger.p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for first in range(0, len(order), 24):
            rows = order[first : first + 24]
            _, grad = tagger.gradients(codes[rows], mask[rows], tags[rows])
            step += 1
            for k, g in grad.items():
                g = np.clip(g, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                tagger.p[k] -= 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return tagger


def reconcile(found: list[tuple[str, int, int, float]], base: list[Span], least: float) -> list[Span]:
    """The set of non-overlapping added spans of largest total margin, none touching a base span.

    The same span seen by several windows keeps its largest margin.
    """
    best: dict[Span, float] = {}
    taken = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in taken])
    reach = np.maximum.accumulate(np.array([b for _, b in taken])) if taken else np.zeros(0)
    for kind, a, b, margin in found:
        before = int(np.searchsorted(starts, b))
        if margin >= least and not (before and reach[before - 1] > a):
            best[kind, a, b] = max(margin, best.get((kind, a, b), 0.0))
    spans = sorted(best, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in spans]
    total, choice = [0.0], []
    for i, s in enumerate(spans):
        free = int(np.searchsorted(ends[:i], s[1], side="right"))
        with_it = total[free] + best[s] * (s[2] - s[1])
        choice.append((with_it > total[i], free))
        total.append(max(total[i], with_it))
    out, i = [], len(spans)
    while i:
        use, free = choice[i - 1]
        if use:
            out.append(spans[i - 1])
        i = free if use else i - 1
    return out


def usable(text: str, span: Span) -> bool:
    """An added span starts and ends at characters that such data has, and has enough of them."""
    kind, a, b = span
    part = text[a:b]
    digits = sum(c in "0123456789" for c in part)
    if not (part[0].isalnum() or part[0] in "+(") or not part[-1].isalnum():
        return False
    return {"email": "@" in part and len(part) >= 6, "ip": digits >= 4 and part.count(".") >= 3, "card": digits >= 12, "phone": digits >= 7}[kind]


def cuttings(text: str, most: int = 4) -> list[str]:
    """Windows of a text with their surroundings: around the first span of each kind, then around other triggers."""
    firsts: dict[str, Span] = {}
    for span in base_spans(text):
        firsts.setdefault(span[0], span)
    parts = [text[max(0, a - WINDOW) : b + WINDOW] for _, a, b in in_order(list(firsts.values()))]
    parts += [text[max(0, start - WINDOW) : start + 2 * WINDOW] for start in window_starts(text)[:most]]
    return list(dict.fromkeys(parts))[:most]


def labelled_by_patterns(dumps: DataFrame, dump_id: str = "dump_id", content: str = "content", most: int = MAX_LABELLED) -> list[tuple[str, list[Span]]]:
    """Labelled spans where no person has labelled any: dumps that hold well-formed spans, cut to their surroundings.

    `most` dumps at most, those of the smallest hash: first an equal share of `most` for each kind of span, then any
    that hold spans, until `most` are found. Repeated rows count once. Each gives up to four windows, around the first
    span of each kind before others, as other digits teach what is no span.
    """
    rows = dumps.select(F.xxhash64(F.col(dump_id), F.col(content)).alias("key"), F.col(content).alias("text"))
    rows = rows.where(F.col("text").rlike("[0-9@]"))

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[str, set[int]] = {kind: set() for kind in KINDS}
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for kind in {span[0] for span in base_spans(text)}:
                    keys[kind].add(key)
            keys = {kind: set(sorted(some)[:most]) for kind, some in keys.items()}
        found = [(kind, key) for kind, some in keys.items() for key in some]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.int64()))], names=["kind", "key"])

    # Keys are chosen first, so that no task gathers whole texts: `most` a kind and task, then `most` a kind.
    by_kind = rows.mapInArrow(smallest, "kind string, key long").distinct()
    place = F.row_number().over(Window.partitionBy("kind").orderBy("key"))
    found: dict[str, list[int]] = {}
    for row in by_kind.withColumn("place", place).where(F.col("place") <= most).orderBy("kind", "key").collect():
        found.setdefault(row.kind, []).append(row.key)
    keys = {key for some in found.values() for key in some[: most // len(KINDS)]}
    keys |= set(sorted({key for some in found.values() for key in some} - keys)[: most - len(keys)])
    chosen = dumps.sparkSession.createDataFrame([(k,) for k in sorted(keys)], "key long")
    rows = rows.join(F.broadcast(chosen), "key", "left_semi").select("key", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [cuttings(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.list_(pa.string()))], names=["key", "parts"])

    examples = []
    # Equal keys have equal parts; one row of each reaches the driver.
    for row in rows.mapInArrow(cut, "key long, parts array<string>").groupBy("key").agg(F.first("parts").alias("parts")).collect():
        examples += [(part, base_spans(part)) for part in row.parts]
    return sorted({text: spans for text, spans in examples}.items())


def find_personal_data(
    dumps: DataFrame, tagger: Tagger, dump_id: str = "dump_id", content: str = "content", least_margin: float = 1.5
) -> DataFrame:
    """Per row: dump_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    n_*: well-formed spans of each kind; base_sha256: of their list; spans: all
    spans, those that the model adds too, as kind:start:end by start, then kind,
    joined by commas; positions are code points of the content, end exclusive.

    Null and empty contents have none. Every text is read whole; a row's result
    depends on that row alone, so repeated rows repeat, and an empty table
    gives an empty table. Added spans never touch a well-formed one.
    """
    shared = dumps.sparkSession.sparkContext.broadcast(tagger)
    schema = "dump_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        nothing = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                bases = [base_spans(t) for t in texts]
                todo = [(i, s) for i, t in enumerate(texts) if _TRIGGER.search(t) for s in window_starts(t)]
                found: dict[int, list] = {}
                for k in range(0, len(todo), 256):
                    some = todo[k : k + 256]
                    for (i, s), spans in zip(some, tagger.decode([texts[i][s : s + WINDOW] for i, s in some]), strict=True):
                        found.setdefault(i, []).extend((kind, s + a, s + b, margin) for kind, a, b, margin in spans)
                rows = []
                for i, (text, base) in enumerate(zip(texts, bases, strict=True)):
                    if not base and i not in found:
                        rows.append(nothing)
                        continue
                    good = [f for f in found.get(i, ()) if usable(text, f[:3])]
                    added = reconcile(good, base, least_margin)
                    counts = [sum(s[0] == kind for s in base) for kind in KINDS]
                    rows.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(in_order(base + added)), len(added)))
                columns = list(zip(*rows, strict=True))
                types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                    names=["dump_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
                )

    found = dumps.select(F.col(dump_id).cast("long").alias("dump_id"), F.col(content).cast("string").alias("content")).mapInArrow(work, schema)
    return found.withColumnRenamed("dump_id", dump_id)
