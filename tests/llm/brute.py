"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NORMAL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def ngrams(text, n):
    words = WORD.findall(lower(text))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(len(words) - n, 0) + 1)}


def components(sets, percent):
    """Smallest id reachable by links, per id; sets: {id: set}."""
    ids = sorted(sets)
    group = {i: i for i in ids}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    group[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def passages(texts, window):
    """{id: (n_words, removed flags, kept text)}; texts: {id: text}."""
    words = {i: WORD.findall(t or "") for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = (len(w), gone, " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def contamination(texts, items, size=13):
    windows, lengths = defaultdict(set), set()
    for name, text in items:
        words = NORMAL.findall(lower(text))
        for k in range(max(len(words) - size, 0) + 1 if words else 0):
            window = tuple(words[k : k + size])
            windows[window].add(str(name))
            lengths.add(len(window))
    out = {}
    for i, text in texts.items():
        words = NORMAL.findall(lower(text))
        hit, found = [False] * len(words), set()
        for n in lengths:
            for k in range(len(words) - n + 1):
                window = tuple(words[k : k + n])
                if window in windows:
                    hit[k : k + n] = [True] * n
                    found |= windows[window]
        out[i] = (len(words), sum(hit), sorted(found), sum(hit) > 0 and 20 * sum(hit) >= len(words))
    return out


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out = {s: 0.0 for s in order}
    open_, left = list(order), share * sum(sizes.values())
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        given = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            room = most * sizes[s] - out[s]
            if given[s] >= room:
                left += given[s] - room
                out[s] = most * sizes[s]
                open_.remove(s)
            else:
                out[s] += given[s]
    return out


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def personal(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())

    def luhn(s):
        total = 0
        for i, c in enumerate(s[::-1]):
            d = int(c) * (2 if i % 2 else 1)
            total += d // 10 + d % 10
        return total % 10 == 0

    found = [(m.start(), 0, m.end(), "email") for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [(m.start(), 2, m.end(), "card") for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(m.start(), 3, m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


def later_lines(texts, percent):
    """{(id, line number)} of lines that match an earlier one; texts: {id: text}."""
    lines = [(i, k, set(line.split(" ")) if line.strip() else set()) for i in sorted(texts) for k, line in enumerate((texts[i] or "").split("\n"))]
    out = set()
    for at, (i, k, s) in enumerate(lines):
        for _, _, r in lines[:at]:
            if s and 100 * len(s & r) >= percent * len(s | r):
                out.add((i, k))
                break
    return out
