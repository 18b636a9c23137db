"""Near-duplicate dumps: an exact Jaccard join over word n-grams, on prefix trees.

A dump's set is its distinct n-grams. Two sets link at a Jaccard similarity of
`percent` / 100 or more; components of links are the near-duplicate groups.

Blocks. Two sets that link differ in few n-grams. The n-grams are dealt into
more parts, by hash, than sets of their size may differ in, so one part at
least must be the same in both: a part's content is a signature, and sets that
share one are candidates. Part numbers follow the set's size band; a set also
signs for the next smaller band where a partner may lie. Candidates gather
around the smallest id of their signature, the hub, once per hub however many
signatures they share.

Trees. Inside a block the n-grams get one order, those of most sets first. The
ordered sets are stored in a prefix tree, each node a run of n-grams. A set
walks the tree once: sets below a node share the overlap counted on the way to
it, and a subtree is left as soon as what remains of it and of the walking set
cannot reach the overlap that their lengths need. Branches are entered only for
candidates: sets of other groups that have one of their rarest n-grams in common
with the walker's (prefix filter; the tail of an ordered set holds them). Sets
that share no more than a common passage thus never walk each other's branches,
and copies that are joined already cost nothing further.

Large blocks. A block is cut into chunks of a bounded number of n-grams, each
with the hub. Sets that a chunk has joined to the hub's group need no further
look at each other; the others (few) are sent to the other chunks of the block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetvitals.llm.components import components
from fleetvitals.llm.storage import stored
from fleetvitals.llm.words import U64, Words, hash_words, lower_ascii, mix, pieces, shingles, split_words

# N-grams in one chunk of a block: what a task holds at a time.
CHUNK_NGRAMS = 1_000_000
# Walking the branches of one candidate takes as long as passing over so many n-grams of a tree.
SWEEP_NGRAMS = 10_000
_PART, _ITEM = U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB)


def bands(percent: int, largest: int) -> tuple[int, list[int]]:
    """(size up to which sets differ by one n-gram at most, upper sizes of the bands above it)."""
    rest = 100 - percent
    small = max(-(-2 * percent // rest) - 1 if rest else largest, 1)
    # A set can have partners in its own band and in the next smaller one, but in no other.
    ratio = max(1.3, 100 / percent + 0.02)
    uppers = []
    last = small
    while last < largest or not uppers:
        last = max(last + 1, int(last * ratio))
        uppers.append(last)
    return small, uppers


def scheme(lower: int, upper: int, percent: int) -> tuple[int, int, int]:
    """(parts, spare ones, n-grams that a part must have to be signed) for sets of lower to upper n-grams.

    Parts with hardly any n-grams are common to many sets. They can be left
    unsigned where a set has no more of them than there are spare parts: of the
    parts that two linked sets share, one more than the spare ones, one is then
    signed by both. The spare ones are as many as chance makes such parts in
    the smallest set of the band, and some more. A set with too many signs all.
    """
    needed = upper * (100 - percent) // percent + 1
    for least in (2, 1):
        for spare in range(1, needed + 2):
            parts = needed + spare
            mean = lower / parts
            share = math.exp(-mean) * (1 + mean * (least > 1))
            if spare >= share * parts + 2 * math.sqrt(share * parts):
                if spare <= 0.3 * needed + 3:
                    return parts, spare, least
                break
    return needed, -1, 0


@lru_cache(maxsize=64)
def _schemes(percent: int, small: int, uppers: tuple[int, ...]) -> np.ndarray:
    return np.array([scheme(low + 1, up, percent) for low, up in zip((small, *uppers), uppers, strict=False)], dtype=np.int64)


class Sets:
    """Distinct n-grams of a run of texts, ordered by text and hash."""

    def __init__(self, texts: pa.Array, n: int):
        words = split_words(texts)
        words = Words(lower_ascii(words.data), words.starts, words.ends, words.bounds)
        owner, value = shingles(hash_words(words), words.bounds, n)
        order = np.lexsort((value, owner))
        owner, value = owner[order], value[order]
        new = np.ones(len(owner), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
        self.owner, self.value = owner[new], value[new]
        self.sizes = np.bincount(self.owner, minlength=len(texts)).astype(np.int64)
        self.bounds = np.concatenate(([0], np.cumsum(self.sizes)))

    def totals(self, values: np.ndarray) -> np.ndarray:
        sums = np.concatenate((np.zeros(1, U64), np.cumsum(values, dtype=U64)))
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]

    def digests(self) -> list[bytes]:
        a, b = self.totals(mix(self.value ^ _ITEM)), self.totals(mix(self.value ^ _PART))
        return [x + y for x, y in zip((v.tobytes() for v in mix(a + self.sizes.astype(U64))), (v.tobytes() for v in b), strict=True)]


def signatures(sets: Sets, percent: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, signature) of all texts but those to skip; texts without n-grams have none."""
    if not len(sets.value):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    small, found = bands(percent, int(sets.sizes.max()) + 1)
    schemes, uppers = _schemes(percent, small, tuple(found)), np.array(found, dtype=np.int64)
    item = mix(sets.value ^ _ITEM)
    totals = sets.totals(item)
    owners, signs = [], []
    # Small sets: the whole set, and each set with one n-gram taken away.
    whole = np.flatnonzero((sets.sizes > 0) & (sets.sizes <= small) & ~skip)
    owners.append(whole)
    signs.append(mix(totals[whole] + sets.sizes[whole].astype(U64)))
    less = (sets.sizes <= small + 1) & (sets.sizes > 1) & ~skip
    take = np.flatnonzero(less[sets.owner])
    owners.append(sets.owner[take])
    signs.append(mix(totals[sets.owner[take]] - item[take] + (sets.sizes[sets.owner[take]] - 1).astype(U64)))
    own = np.searchsorted(uppers, sets.sizes)  # band of each text
    for step in (0, 1):
        band = own - step
        least = -(-sets.sizes * percent // 100)
        in_band = (sets.sizes > small) & (band >= 0) & ~skip
        if step:
            in_band &= least <= uppers[np.maximum(band, 0)]
        parts, spare, enough = schemes[np.clip(band, 0, len(uppers) - 1)].T
        parts = np.where(in_band, parts, 0)
        base = np.concatenate(([0], np.cumsum(parts)))
        take = np.flatnonzero(in_band[sets.owner])
        who = sets.owner[take]
        number = ((mix(sets.value[take] ^ _PART) >> U64(32)) * parts[who].astype(U64) >> U64(32)).astype(np.int64)
        slot = base[who] + number
        order = np.argsort(slot, kind="stable")
        at = np.concatenate((np.zeros(1, U64), np.cumsum(item[take][order], dtype=U64)))
        counts = np.bincount(slot, minlength=base[-1])
        stops = np.cumsum(counts)
        sums = at[stops] - at[stops - counts]
        slot_owner = np.repeat(np.arange(len(parts)), parts)
        signed = counts >= enough[slot_owner]
        few = np.bincount(slot_owner, weights=~signed, minlength=len(parts))
        keep = signed | (few > spare)[slot_owner]
        part_no = np.arange(base[-1]) - base[slot_owner]
        tag = (part_no * 4096 + band[slot_owner]).astype(U64)
        owners.append(slot_owner[keep])
        signs.append(mix(sums + mix(tag * U64(1 << 20) + counts.astype(U64)))[keep])
    return np.concatenate(owners), np.concatenate(signs)


class _Tree:
    """Prefix tree of ordered sets: runs of n-gram ranks, with the sets that end at a node."""

    __slots__ = ("run", "children", "ends", "least", "longest", "above", "wanted")

    def __init__(self, run: np.ndarray):
        self.run, self.children, self.ends = run, {}, []
        self.least, self.longest = 1 << 60, 0  # sizes of the sets below: smallest, largest
        self.above: _Tree | None = None
        self.wanted = -1  # the last walker that had a candidate below


def _insert(root: _Tree, ranks: np.ndarray, who: int) -> None:
    node, at, size, path = root, 0, len(ranks), [root]
    while at < size:
        child = node.children.get(int(ranks[at]))
        if child is None:
            child = _Tree(ranks[at:])
            child.above = node
            node.children[int(ranks[at])] = child
            at = size
        else:
            n = min(len(child.run), size - at)
            differ = np.flatnonzero(child.run[:n] != ranks[at : at + n])
            same = int(differ[0]) if len(differ) else n
            if same < len(child.run):
                lower = _Tree(child.run[same:])
                lower.children, lower.ends, lower.least, lower.longest = child.children, child.ends, child.least, child.longest
                for c in lower.children.values():
                    c.above = lower
                lower.above = child
                child.run, child.children, child.ends = child.run[:same], {int(lower.run[0]): lower}, []
            at += same
        node = child
        path.append(child)
    node.ends.append(who)
    for p in path:
        p.least, p.longest = min(p.least, size), max(p.longest, size)


class Block:
    """Sets of one chunk; joins them by walking their prefix tree."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.n = percent, len(sets)
        values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(values), dtype=np.int64)
        rank[np.lexsort((values, -counts))] = np.arange(len(values))
        self.n_ranks = len(values)
        stops = np.cumsum([len(s) for s in sets])
        self.sets = [np.sort(rank[inverse[stop - len(s) : stop]]) for s, stop in zip(sets, stops, strict=True)]
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.group = np.arange(self.n)
        self.visits = 0  # nodes that walkers have stopped at
        self.root = _Tree(np.zeros(0, np.int64))
        for i, s in enumerate(self.sets):
            _insert(self.root, s, i)
        # The tree once more as a tour: each node where it is entered and, with sign -1, where it is left.
        self.leaf: dict[int, _Tree] = {}
        self.entered = np.zeros(self.n, dtype=np.int64)
        runs, tour, sign = [], [], []
        todo: list[_Tree | int] = list(self.root.children.values())
        while todo:
            node = todo.pop()
            if isinstance(node, int):
                tour.append(node)
                sign.append(-1)
                continue
            self.entered[node.ends] = len(tour)
            self.leaf.update(dict.fromkeys(node.ends, node))
            todo.append(len(runs))
            tour.append(len(runs))
            sign.append(1)
            runs.append(node.run)
            todo += node.children.values()
        self.tour, self.sign = np.array(tour), np.array(sign)
        self.runs, lengths = np.concatenate(runs), [len(r) for r in runs]
        self.starts = np.cumsum(lengths) - lengths
        # The sets by the n-grams of their tails: holders[at[r]:at[r + 1]] have the n-gram of rank r there.
        tails = [self._tail(i) for i in range(self.n)]
        held = np.concatenate(tails)
        self.holders = np.repeat(np.arange(self.n), [len(t) for t in tails])[np.argsort(held, kind="stable")]
        self.at = np.concatenate(([0], np.cumsum(np.bincount(held, minlength=self.n_ranks))))

    def _tail(self, i: int) -> np.ndarray:
        """A set's rarest n-grams, so many that one is common, and in the tail of the other, for any set that it links with."""
        size = len(self.sets[i])
        return self.sets[i][-(-size * self.percent // 100) - 1 if self.percent else 0 :]

    def find(self, i: int) -> int:
        return int(self.group[i])

    def links(self, walkers: range | list[int]) -> list[tuple[int, int]]:
        """Links that join groups, found by letting each walker search the tree."""
        out = []
        members = {i: [i] for i in range(self.n)}
        walked = np.zeros(self.n, dtype=bool)
        all_walk = len(walkers) == self.n
        for x in walkers:
            # Where all walk, sets outside the first set's group come upon those inside it.
            if all_walk and x and self.group[x] == self.group[0]:
                continue
            candidates = self._candidates(x, walked)
            # Many candidates are found by one pass over the arrays of the whole tree, few by their branches.
            search = self._sweep if len(candidates) * SWEEP_NGRAMS > len(self.runs) else self._walk
            for y in search(x, candidates):
                a, b = self.find(x), self.find(y)
                if a != b:
                    out.append((x, y))
                    if len(members[a]) < len(members[b]):
                        a, b = b, a
                    self.group[members[b]] = a
                    members[a] += members.pop(b)
            walked[x] = True
        return out

    def _candidates(self, x: int, walked: np.ndarray) -> np.ndarray:
        """Sets of other groups that share an n-gram of their tails with x, but those that have met x as walkers."""
        tail = self._tail(x)
        starts, stops = self.at[tail], self.at[tail + 1]
        near = np.zeros(self.n, dtype=bool)
        for start, stop in zip(starts[stops - starts > 1], stops[stops - starts > 1], strict=True):
            near[self.holders[start:stop]] = True
        size = self.sizes[x]
        near &= (self.sizes * 100 >= size * self.percent) & (self.sizes * self.percent <= size * 100)
        return np.flatnonzero(near & ~walked & (self.group != self.group[x]))

    def _sweep(self, x: int, candidates: np.ndarray) -> list[int]:
        """Candidates that link with x, by a walk of the whole tree along its tour."""
        has = np.zeros(self.n_ranks, dtype=np.int32)
        has[self.sets[x]] = 1
        along = np.cumsum(np.add.reduceat(has[self.runs], self.starts)[self.tour] * self.sign)
        overlap = along[self.entered[candidates]]
        self.visits += len(candidates)
        linked = (100 + self.percent) * overlap >= self.percent * (self.sizes[x] + self.sizes[candidates])
        return candidates[linked].tolist()

    def _walk(self, x: int, candidates: np.ndarray) -> Iterator[int]:
        """Candidates that link with x; only branches that hold some are walked, and none for sets that joined its group on the way."""
        if not len(candidates):
            return
        for y in candidates.tolist():
            up: _Tree | None = self.leaf[y]
            while up is not None and up.wanted != x:
                up.wanted = x
                up = up.above
        own, group, wanted = self.sets[x], self.group, set(candidates.tolist())
        size, percent = len(own), self.percent
        has = np.zeros(self.n_ranks, dtype=bool)
        has[own] = True
        todo = [(c, 0, 0) for c in self.root.children.values() if c.wanted == x]
        while todo:
            node, overlap, depth = todo.pop()
            ends = [y for y in node.ends if y in wanted and group[y] != group[x]]
            if not ends and not node.children:
                continue
            self.visits += 1
            if node.longest * 100 < size * percent or node.least * percent > size * 100:
                continue
            overlap += int(np.count_nonzero(has[node.run]))
            depth += len(node.run)
            rest = size - int(own.searchsorted(node.run[-1], side="right"))
            best = overlap + min(rest, node.longest - depth)
            # 100 I >= p (|x| + |y| - I), for the smallest |y| below
            if (100 + percent) * best < percent * (size + max(node.least, best)):
                continue
            if (100 + percent) * overlap >= percent * (size + depth):
                yield from ends
            todo += [(c, overlap, depth) for c in node.children.values() if c.wanted == x]


def _join_blocks(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Joins rows (hub, chunk, role, id, content), sorted by block; role 0 is the hub, 1 a member, 2 a guest.

    Gives links (a, b) and, with b null, members outside the hub's group. Where
    there are guests, only pairs with a guest are looked for.
    """
    schema = "hub long, chunk long, a long, b long"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, ids, roles, sets = None, [], [], []
        for batch in batches:
            for part in pieces(batch, "content"):
                found = Sets(part.column(4), n)
                hubs, chunks, kinds, who = (part.column(i).to_pylist() for i in range(4))
                for i in range(part.num_rows):
                    if key != (hubs[i], chunks[i]):
                        if ids:
                            yield key, ids, roles, sets
                        key, ids, roles, sets = (hubs[i], chunks[i]), [], [], []
                    if found.sizes[i]:
                        ids.append(who[i])
                        roles.append(kinds[i])
                        sets.append(found.value[found.bounds[i] : found.bounds[i + 1]].copy())
        if ids:
            yield key, ids, roles, sets

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (hub, chunk), ids, roles, sets in blocks(batches):
            out = []
            if len(ids) > 1:
                block = Block(sets, percent)
                guests = [i for i, r in enumerate(roles) if r == 2]
                found = block.links(guests or range(len(ids)))
                out += [(ids[x], ids[y]) for x, y in found]
                if not guests:
                    first = block.find(0)
                    out += [(ids[i], None) for i in range(len(ids)) if block.find(i) != first]
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hub] * len(a), pa.int64()), pa.array([chunk] * len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                    names=["hub", "chunk", "a", "b"],
                )

    return rows.repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "role", "id").mapInArrow(work, schema)


def _sizes(dumps: DataFrame, n: int) -> DataFrame:
    schema = "id long, n_shingles long, digest binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "content"):
                sets = Sets(part.column(1), n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sets.sizes), pa.array(sets.digests(), pa.binary())], names=["id", "n_shingles", "digest"]
                )

    return dumps.mapInArrow(work, schema)


def _signed(dumps: DataFrame, n: int, percent: int) -> DataFrame:
    """(sign, id): signatures of all sets; of equal sets in one task only the first signs."""
    schema = "sign long, id long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in pieces(batch, "content"):
                sets = Sets(part.column(1), n)
                skip = np.zeros(part.num_rows, dtype=bool)
                for i, d in enumerate(sets.digests()):
                    skip[i] = d in seen
                    seen.add(d)
                owner, sign = signatures(sets, percent, skip)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sign.view(np.int64)), part.column(0).take(pa.array(owner))], names=["sign", "id"]
                )

    return dumps.mapInArrow(work, schema)


def near_duplicates(
    dumps: DataFrame,
    n: int = 5,
    percent: int = 80,
    dump_id: str = "dump_id",
    content: str = "content",
    chunk_ngrams: int = CHUNK_NGRAMS,
) -> DataFrame:
    """Per row: dump_id, n_shingles, component_id.

    Words are runs without white space, A-Z in lower case. A dump's set are its
    distinct runs of n words; with fewer words, the whole sequence is its only
    one; without words or content it is empty and links with nothing.
    component_id is the smallest dump_id that links lead to, itself included.
    n-grams are compared by 64-bit hashes; within that, no link is lost.

    Rows of equal id are one dump with the n-grams of each of its rows apart,
    and share a component; each has a row. A dump without an id has a null
    component and links nothing. An empty table gives an empty table.
    """
    source = dumps.select(F.col(dump_id).cast("long").alias("id"), F.coalesce(F.col(content), F.lit("")).alias("content"))
    sizes = stored(_sizes(source, n), "ngram-sizes")
    named = source.where(F.col("id").isNotNull() & (F.col("content") != ""))
    # The hub of a signature is its smallest id; rows are two numbers, whatever the texts. (Aggregated and joined back
    # instead, the many signatures of one set each took executors over 3000 MB.)
    by_sign = Window.partitionBy("sign")
    near = (
        _signed(named, n, percent)
        .withColumn("hub", F.min("id").over(by_sign))
        .where("id <> hub")
        .select("hub", "id")
        .distinct()
    )
    near = stored(near, "ngram-near")
    members = near.unionByName(near.select("hub", F.col("hub").alias("id")).distinct())
    counted = sizes.where("id is not null").groupBy("id").agg(F.max("n_shingles").alias("size"))
    chunks = (
        members.join(counted, "id").groupBy("hub").agg(F.greatest(F.lit(1), F.ceil(F.sum("size") / chunk_ngrams)).alias("chunks"))
    )
    dealt = members.join(chunks, "hub")
    dealt = stored(
        dealt.where("id <> hub")
        .select("hub", "chunks", "id", F.lit(1).alias("role"), F.pmod(F.xxhash64("id"), F.col("chunks")).alias("chunk"))
        .unionByName(
            dealt.where("id = hub").select(
                "hub", "chunks", "id", F.lit(0).alias("role"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)).alias("chunk")
            )
        ),
        "ngram-blocks",
    )
    columns = ["hub", "chunk", "role", "id", "content"]
    # Members grow with the input, so their join with the contents is a merge join at every size.
    named = named.hint("merge")
    found = stored(_join_blocks(dealt.join(named, "id").select(*columns), n, percent), "ngram-links")
    links = found.where("b is not null").select("a", "b")
    # Members of large blocks that their chunk could not join to the hub visit the block's other chunks.
    apart = found.where("b is null").select("hub", F.col("a").alias("id"), F.col("chunk").alias("home"))
    apart = apart.join(chunks.where("chunks > 1"), "hub")
    if not apart.isEmpty():
        # One block per pair of a chunk and a home chunk, so no block holds more than two chunks.
        pair = (F.col("chunk") * F.col("chunks") + F.col("home")).alias("chunk")
        guests = apart.select(
            "hub", "id", "home", "chunks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)).alias("chunk")
        ).where("chunk <> home")
        visits = guests.select("hub", "chunk", "home").distinct()
        hosts = dealt.join(visits, ["hub", "chunk"]).select("hub", pair, "role", "id")
        again = hosts.unionByName(guests.select("hub", pair, F.lit(2).alias("role"), "id"))
        found = stored(_join_blocks(again.join(named, "id").select(*columns), n, percent), "ngram-guests")
        links = links.unionByName(found.where("b is not null").select("a", "b"))
    same = sizes.where("id is not null and n_shingles > 0")
    first = same.groupBy("digest").agg(F.min("id").alias("b"))
    copies = same.join(first, "digest").where("id <> b").select(F.col("id").alias("a"), "b")
    grouped = components(links.unionByName(copies))
    return sizes.join(grouped, F.col("id") == F.col("node"), "left").select(
        F.col("id").alias(dump_id), "n_shingles", F.coalesce("component", "id").alias("component_id")
    )
