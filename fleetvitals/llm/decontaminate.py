"""Benchmark decontamination: one automaton over the test items, one pass over each dump.

The library has no test questions of its own; the items are any table of
(item_id, text) against which dumps used for training must not be known.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetvitals.llm.storage import stored
from fleetvitals.llm.words import binary_of

# Letters and digits of ASCII, and every byte of longer code points, make words; A to Z count as a to z.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

# Windows in one automaton; more items are scanned in several passes, each with its own.
MAX_WINDOWS = 250_000
# A character of a window is a node of the automaton at most, of about 40 bytes.
MAX_CHARACTERS = 3_000_000


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def item_windows(text: str | None, size: int) -> list[bytes]:
    """Runs of `size` words, each framed by spaces; an item of fewer words, but not none, is one window."""
    words = normal_words((text or "").encode())
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(max(len(words) - size, 0) + 1)]


def build_automaton(items: list[tuple[str, str | None]], size: int) -> tuple[bytes, int]:
    """Pickle-ready automaton whose values are (words in the window, positions of its items)."""
    held: dict[bytes, set[int]] = {}
    for number, (_, text) in enumerate(items):
        for window in item_windows(text, size):
            held.setdefault(window, set()).add(number)
    automaton = ahocorasick.Automaton()
    for window, numbers in held.items():
        automaton.add_word(window.decode("latin-1"), (window.count(b" ") - 1, tuple(sorted(numbers))))
    if held:
        automaton.make_automaton()
    return automaton, len(held)


def scan(text: bytes, automaton: ahocorasick.Automaton) -> tuple[list[bytes], np.ndarray, set[int]]:
    """Words of a text, which of them lie in an occurrence of a window, and the numbers of the items found."""
    words = normal_words(text)
    hit = np.zeros(len(words), dtype=bool)
    found: set[int] = set()
    if words and len(automaton):
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        spaces = None
        for end, (n, numbers) in automaton.iter(line):
            if spaces is None:  # offsets in the joined line to word numbers, only where something matches
                spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), dtype=np.uint8) == 32)
            last = int(np.searchsorted(spaces, end))
            hit[last - n : last] = True
            found.update(numbers)
    return words, hit, found


def original_spans(text: bytes, hit: np.ndarray) -> list[list[int]]:
    """Code-point ranges, end exclusive, of the hit words in the original text; neighbouring hits make one range."""
    flat = np.frombuffer(text.translate(_NORMAL), dtype=np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flat.view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)))
    return [[int(chars[starts[a]]), int(chars[ends[b - 1]])] for a, b in _runs(hit)]


SCHEMA = "row_no long, text string, n_words long, n_hit long, spans array<array<int>>, hits array<array<int>>, items array<string>"


def _runs(hit: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return [[int(a), int(b)] for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _pass(dumps: DataFrame, items: list[tuple[str, str | None]], size: int, last: bool) -> DataFrame:
    """Adds what one automaton finds to what earlier ones have found; the text goes on only if more follow."""
    automaton, _ = build_automaton(items, size)
    shared = dumps.sparkSession.sparkContext.broadcast((automaton, [name for name, _ in items]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, names = shared.value
        for batch in batches:
            data, offsets = binary_of(batch.column(1))
            before = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                words, hit, found = scan(text, automaton)
                for low, high in before[0][i]:
                    hit[low:high] = True
                spans = original_spans(text, hit) if hit.any() else []
                rows.append((len(words), int(hit.sum()), spans, _runs(hit), sorted({*before[1][i], *(names[n] for n in found)} - {None})))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            pairs = pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.nulls(batch.num_rows, pa.string()) if last else batch.column(1),
                    *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pairs, pairs, pa.list_(pa.string())), strict=True)),
                ],
                names=["row_no", "text", "n_words", "n_hit", "spans", "hits", "items"],
            )

    return dumps.select("row_no", "text", "hits", "items").mapInArrow(work, SCHEMA)


def find_contamination(
    dumps: DataFrame,
    items: DataFrame,
    window: int = 13,
    share: int = 20,
    dump_id: str = "dump_id",
    content: str = "content",
    item_id: str = "item_id",
    item_text: str = "text",
    max_windows: int = MAX_WINDOWS,
    max_characters: int = MAX_CHARACTERS,
) -> DataFrame:
    """Per dump: dump_id, n_words, n_hit, n_items, items, spans, items_sha256, contaminated.

    A window is `window` consecutive words of an item; an item of fewer words
    is one window. A word inside any occurrence of a window is hit. spans are
    code-point ranges of hit words in the original content; items the ids found,
    sorted as text. contaminated: n_hit > 0 and share * n_hit >= n_words.

    Items are read in groups of `max_windows` windows and `max_characters`
    characters of them at most (one item at least); each group makes one
    broadcast automaton and one pass, so the broadcast stays bounded in bytes
    however many items there are. Null and empty
    content has no words and is clean; items without words match nothing;
    repeated dumps give repeated rows; rows without an id keep their null id.
    Words of an item without an id are hit like any, but it is not among the
    items found.
    """
    source = dumps.select(F.col(dump_id).cast("long").alias("row_no"), F.col(content).cast("string").alias("text"))
    wanted = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("item_text"))
    wanted = wanted.where(F.col("item_text").isNotNull())
    found = source.withColumns(
        {"hits": F.array().cast("array<array<int>>"), "items": F.array().cast("array<string>")}
    )
    group, n, size = [], 0, 0
    for row in wanted.orderBy("item", "item_text").toLocalIterator():
        windows = item_windows(row.item_text, window)
        more, longer = len(windows), sum(map(len, windows))
        if group and (n + more > max_windows or size + longer > max_characters):
            found = stored(_pass(found, group, window, last=False), "contamination")
            group, n, size = [], 0, 0
        group.append((row.item, row.item_text))
        n, size = n + more, size + longer
    found = _pass(found, group, window, last=True)
    return found.select(
        F.col("row_no").alias(dump_id),
        "n_words",
        "n_hit",
        "items",
        "spans",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )
