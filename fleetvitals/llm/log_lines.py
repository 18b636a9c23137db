"""Near-duplicate lines of dumps and logs: an exact set-similarity join in DataFrame functions.

Error logs and dumps repeat lines that differ in a time or a number. One other
token in n distinct ones leaves a similarity of (n - 1) / (n + 1): at 80 % such
lines match from 9 tokens on, at 90 % only from 19. A line's
set is its distinct tokens, what stands between spaces. Lines of equal sets
fall together first (a class); classes are joined by prefix filtering:

- tokens are ordered by rarity: how often they occur, over all lines. That is
  looked up in a table of one level per bucket of token hashes (of all tokens
  in the bucket, logarithmic), so any number of tokens fits a
  literal of a fixed size; the order is the same for all lines, which is all
  that exactness needs;
- two sets of similarity t share a token among their first
  |x| - ceil(t |x|) + 1; only these prefixes are joined;
- of the pairs that meet, lengths and the positions of the shared token bound
  the overlap that is left, and sketches bound it from the bits by which they
  differ; pairs that cannot reach t are dropped in the join;
- the rest is verified on the lines themselves. As one earlier match decides
  about a line, every class first meets the earliest class of a few of its
  tokens only; those still open then meet the others, half the tokens at a time.
  Many alike thus make few pairs, and shuffles end with each step.

Classes and candidates go by hashes of tokens; verification compares the tokens themselves.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetvitals.llm.storage import discard, shuffles_end_with_queries, stored

BUCKET_BITS = 16
LEVEL_BITS = 8
MEET_MASK = (1 << 31) - 1
LONG_SET = 80
HUB_KEYS = 3
KEY_SHARES = 2  # the keys are joined in so many turns, each with its own shuffle


def _level(levels: Column, token_hash: Column) -> Column:
    return F.get(levels, F.shiftrightunsigned(token_hash, 64 - BUCKET_BITS).cast("int")).cast("bigint")


def line_set(line: Column, levels: Column) -> Column:
    """A line's distinct tokens as numbers, rarest first: the level in the upper bits, the hash in the lower ones."""

    def key(h: Column) -> Column:
        # No element can be null for Spark either, so the array is sorted as plain numbers.
        level = F.coalesce(_level(levels, h), F.lit(0).cast("long"))
        return F.shiftleft(level, 64 - LEVEL_BITS - 1).bitwiseOR(F.shiftrightunsigned(h, LEVEL_BITS + 1))

    hashes = F.array_distinct(F.transform(F.split(line, " "), lambda token: F.xxhash64(token)))
    return F.sort_array(F.transform(hashes, key))


def sketch(keys: Column) -> Column:
    """Bits that each hold the parity of the keys that fall on them: two sets differ in as many keys at least as in bits.

    `all` has 64 bits for all keys; `odd` those of every other key, for sets above LONG_SET keys only, which have 128 bits by it.
    """

    def word(bit: Callable[[Column], Column]) -> Column:
        return F.aggregate(keys, F.lit(0).cast("long"), lambda found, k: found.bitwiseXOR(F.call_function("shiftleft", bit(k), k.bitwiseAND(63).cast("int"))))

    odd = F.when(F.size(keys) > LONG_SET, word(lambda k: F.shiftright(k, 6).bitwiseAND(1))).otherwise(F.lit(0).cast("long"))
    return F.struct(word(lambda k: F.lit(1).cast("long")).alias("all"), odd.alias("odd"))


def rarity(contents: DataFrame) -> Column:
    """The table of levels: per bucket of token hashes, 4 times the logarithm of how many tokens fall into it.

    contents: (content). Counted over all of them; what reaches the driver, and
    what a task has to shuffle, is one number for each of the 2 ** BUCKET_BITS buckets.
    """
    tokens = contents.select(F.explode(F.split(F.replace("content", F.lit("\n"), F.lit(" ")), " ")).alias("t"))
    bucket = F.shiftrightunsigned(F.xxhash64("t"), 64 - BUCKET_BITS).cast("int").alias("bucket")
    levels = [0] * (1 << BUCKET_BITS)
    for row in tokens.groupBy(bucket).agg(F.count("*").alias("n")).collect():
        levels[row.bucket] = min(4 * (row.n.bit_length() - 1) + (4 * row.n >> (row.n.bit_length() - 1)) % 4, 127)
    return F.split(F.lit(",".join(map(str, levels))), ",").cast("array<tinyint>")


def _sources(dumps: DataFrame, dump_id: str, content: str) -> DataFrame:
    return dumps.select(
        F.col(dump_id).cast("long").alias("dump"), F.xxhash64(F.col(dump_id), F.col(content)).alias("row_key"), F.col(content).alias("content")
    )


def _verified(pairs: DataFrame, source: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(class) of the later ones of pairs (late, early) that are as similar as wanted, compared on their tokens."""
    pairs = stored(pairs, "line-pairs")
    wanted = pairs.select(F.col("late").alias("class")).unionByName(pairs.select(F.col("early").alias("class"))).distinct()
    spots = wanted.join(classes.select("class", "first.*"), "class").groupBy("row_key").agg(F.collect_list(F.struct("class", "line_no")).alias("spots"))
    # The lines are cut out of their dumps, which are joined once by key; rows that repeat as a whole give each line once.
    texts = (
        source.join(spots, "row_key")
        .select(F.split("content", "\n", -1).alias("all"), F.explode("spots").alias("s"))
        .groupBy("s.class").agg(F.min(F.get("all", F.col("s.line_no"))).alias("line"))
    )
    x, y = F.split("x", " "), F.split("y", " ")
    found = (
        pairs.join(texts.toDF("late", "x"), "late").join(texts.toDF("early", "y"), "early")
        .where(F.size(F.array_intersect(x, y)) * 100 >= F.size(F.array_union(x, y)) * percent)
        .select(F.col("late").alias("class"))
        .distinct()
    )
    found = stored(found, "lines-decided")
    discard(pairs)
    return found


def _judged(source: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines with their classes, the classes, and those of them that match an earlier class."""
    levels = rarity(source.where(F.col("dump").isNotNull()))
    exploded = source.where(F.col("dump").isNotNull()).select("dump", "row_key", F.posexplode(F.split("content", "\n", -1)).alias("line_no", "line"))
    sets = exploded.where(F.btrim("line", F.lit(" \t\r\v\f")) != "").select("dump", "row_key", "line_no", line_set(F.col("line"), levels).alias("keys"))
    n = F.size("keys")
    least = F.ceil(n * percent / F.lit(100.0) - 1e-9).cast("int")
    # The lower bits of a key are enough to meet by: keys that share them only make a candidate more.
    prefix = F.transform(F.slice("keys", 1, n - least + 1), lambda k: k.bitwiseAND(MEET_MASK).cast("int"))
    sets = stored(
        sets.select("dump", "row_key", "line_no", n.alias("n"), F.xxhash64("keys").alias("class"), prefix.alias("prefix"), sketch(F.col("keys")).alias("sketch")),
        "line-sets",
    )
    # One row per class; what a task has of it is combined before the shuffle, so a very common line costs one row per task.
    classes = stored(
        sets.groupBy("class").agg(
            F.min(F.struct("dump", "line_no", "row_key")).alias("first"), F.max("n").alias("n"), F.min("prefix").alias("prefix"), F.min("sketch").alias("sketch")
        ),
        "line-classes",
    )
    lines = stored(sets.select("dump", "row_key", "line_no", "class"), "lines")
    discard(sets)
    # Shorter sets than this are similar to none but their own.
    shortest = -(-percent // (100 - percent)) if percent < 100 else 1 << 30
    joined = classes.where(F.col("n") >= shortest).select(
        "class", "n", F.col("first.dump").alias("dump"), F.col("first.line_no").alias("line_no"), "sketch.all", "sketch.odd", "prefix"
    )
    # Plain comparisons, and those that drop most pairs first: they are made for every two classes that share a key.
    after = (F.col("line_no") > F.col("line_no_b")) | ((F.col("line_no") == F.col("line_no_b")) & (F.col("class") > F.col("class_b")))
    later = (F.col("dump") > F.col("dump_b")) | ((F.col("dump") == F.col("dump_b")) & after)
    both = F.col("n") + F.col("n_b")
    lengths = (F.col("n") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n") * percent)
    # Of n + n_b keys a share of (100 - percent) / (100 + percent) may differ, and the sketches in no more bits.
    odd, every = (F.col(c).bitwiseXOR(F.col(f"{c}_b")) for c in ("odd", "all"))
    wide = F.when((F.col("n") > LONG_SET) & (F.col("n_b") > LONG_SET), F.bit_count(odd) + F.bit_count(every.bitwiseXOR(odd))).otherwise(0)
    near = (F.bit_count(every) * (100 + percent) <= both * (100 - percent)) & (wide * (100 + percent) <= both * (100 - percent))
    columns = [F.col("class").alias("late"), F.col("class_b").alias("early")]
    # First each class with the earliest of those that meet it by one of HUB_KEYS keys: in a group of many alike, that already decides most.
    figures = ("class", "n", "dump", "line_no", "all", "odd")
    few = joined.select(*figures, F.explode(F.slice(F.sort_array("prefix"), 1, HUB_KEYS)).alias("key"))
    hub = F.first(F.struct(*figures)).over(Window.partitionBy("key").orderBy("dump", "line_no", "class"))
    by_hub = few.withColumn("h", hub).select(*figures, *[F.col(f"h.{c}").alias(f"{c}_b") for c in figures])
    decided = _verified(by_hub.where(near & lengths & later).select(*columns).distinct(), source, classes, percent)
    # Then the classes that are still open with all earlier ones, a share of the keys at a time. Both sides of the join
    # read one shuffle: what tells them apart stands in conditions on both.
    marked = joined.join(decided.select("class", F.lit(False).alias("open")), "class", "left").withColumn("open", F.coalesce("open", F.lit(True)))
    figures = (*figures, "rest", "open")
    # By a shared key at some place, the keys from there on bound the overlap.
    rest = F.least("rest", "rest_b") * (100 + percent) >= both * percent
    still = F.when(F.col("open"), F.col("n_b")).otherwise(0) > 0
    found = []
    for share in range(KEY_SHARES):
        entries = (
            marked.select(*figures[:-2], "open", F.posexplode("prefix").alias("position", "key"))
            .where(F.col("key") % KEY_SHARES == share).select("key", *figures[:-2], (F.col("n") - F.col("position")).alias("rest"), "open")
        )
        others = entries.select("key", *[F.col(c).alias(f"{c}_b") for c in figures])
        found.append(stored(entries.join(others, "key").where(near & lengths & rest & still & later).select(*columns).distinct(), "line-pairs"))
    pairs = functools.reduce(DataFrame.unionByName, found).distinct()
    late = decided.unionByName(_verified(pairs, source, classes, percent)).distinct().select("class", F.lit(True).alias("late"))
    return lines, classes, late


def _later(source: DataFrame, percent: int) -> DataFrame:
    """(dump, row_key, line_no) of lines that match an earlier one."""
    with shuffles_end_with_queries(source.sparkSession):
        lines, classes, late = _judged(source, percent)
    judged = classes.select("class", "first").join(late, "class", "left")
    return (
        lines.join(judged, "class")
        .where(F.coalesce("late", F.lit(False)) | (F.struct("dump", "line_no", "row_key") > F.col("first")))
        .select("dump", "row_key", "line_no")
    )


def duplicate_lines(dumps: DataFrame, percent: int = 90, dump_id: str = "dump_id", content: str = "content") -> DataFrame:
    """Lines that match an earlier one: (dump_id, row_key, line_no), one row each.

    A line is a later match if a line of a smaller (dump_id, line number), of
    any dump, has a Jaccard similarity of percent / 100 or more to it; whether
    that line stays itself does not matter. Blank lines match nothing. row_key
    is a hash of id and content, which tells rows of equal id apart.
    """
    return _later(_sources(dumps, dump_id, content), percent).withColumnRenamed("dump", dump_id)


def remove_duplicate_lines(dumps: DataFrame, percent: int = 90, dump_id: str = "dump_id", content: str = "content") -> DataFrame:
    """Per row: dump_id, n_lines, n_removed, kept_text.

    Lines end at line feeds; a line that matches an earlier one (see
    duplicate_lines) goes, the others stay as they are. Null content has no
    lines and a null kept_text. A dump without an id neither removes nor loses
    lines. Identical rows (same id and content) are one dump: what goes from
    one goes from all. An empty table gives an empty table.
    """
    source = _sources(dumps, dump_id, content)
    gone = _later(source, percent).groupBy("row_key").agg(F.collect_set("line_no").alias("gone"))
    all_lines = F.split("content", "\n", -1)
    kept = F.when(F.col("gone").isNull(), F.col("content")).otherwise(
        F.array_join(F.filter(all_lines, lambda line, i: ~F.array_contains("gone", i)), "\n")
    )
    return source.join(gone, "row_key", "left").select(
        F.col("dump").alias(dump_id),
        F.coalesce(F.size(all_lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        kept.alias("kept_text"),
    )
