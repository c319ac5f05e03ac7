"""Near-duplicate records: exact similarity join on word sets by tiled exclusive-or of bit sketches.

Two records are linked when the Jaccard similarity of their word sets is at least a threshold ``t``.  Nothing is
approximate:

* Records with the same word set form one *class*; the join runs over classes only, so copies never meet in pairs.
* If ``J(A, B) >= t`` then, under any one order of all words, the first ``|X| - ceil(t |X|) + 1`` words of both sets share
  a word.  Classes are blocked by those words, rarest first: words are counted exactly by a group-by, and those of ``FEW``
  classes or more, at most ``MOST_WORDS``, are ordered by their count; the others, all rarer, come before them by their hash.
* Within a block the classes carry a parity sketch, of 256 bits, or of 1024 for pairs with a set over ``LONG`` words.  A bit
  differs only where a word is in one set and not the other, so ``popcount(a ^ b) <= |A xor B| <= (1-t)/(1+t) (|A|+|B|)``
  for every true pair.  Sketches lie in tiles; tile pairs whose population counts differ beyond that radius are skipped, the
  others are compared with numpy exclusive-or and bit counts.
* Pairs within the radius are checked exactly on the word sets.

Blocks of more than ``CELL_ROWS`` classes, by their own counts, are cut into cells, and every pair of cells is a task group of
its own, so no task receives an unbounded block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.session import stored

#: Words in fewer classes than this need no order among each other: their blocks are small.
FEW = 16
#: Counted words that are broadcast, 16 bytes each; with more, FEW is doubled until those left are no more than this.
MOST_WORDS = 1 << 21
#: Blocks over CELL_ROWS that are broadcast with their sizes; more of them are joined.
MOST_BLOCKS = 1 << 18
#: Classes that one cell of a block may hold before the block is split.
CELL_ROWS = 1 << 14
TILE = 64
#: 64-bit words of a sketch where both sets have up to LONG words, and where one has more.
LANES = (4, 16)
LONG = 250


def word_set(text: Column) -> Column:
    """The different words of a text, as hashes in ascending order; null stays null."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)))
    return F.array_sort(F.transform(words, lambda w: F.xxhash64(w)))


def classes_of(df: DataFrame, id_col: str, text_col: str, min_words: int) -> tuple[DataFrame, DataFrame]:
    """``members(id, key)`` and ``classes(key, words)``: one class for each different word set of ``min_words`` or more."""
    rows = df.select(F.col(id_col).alias("id"), word_set(F.col(text_col)).alias("words")).where(F.size("words") >= min_words)
    keyed = rows.select("id", "words", F.unhex(F.md5(F.concat_ws(",", F.col("words").cast("array<string>")))).alias("key"))
    classes = stored(keyed.groupBy("key").agg(F.first("words").alias("words")))
    members = stored(keyed.where(F.col("id").isNotNull()).select("id", "key").distinct())
    return members, classes


def _common_words(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most common words in ascending order and in how many classes each is, at most ``MOST_WORDS``.

    Counts are exact.  Any order of words that all classes share gives the same pairs; this one keeps the blocks small.
    """
    counts = stored(classes.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= FEW))
    level = (F.length(F.bin("n")) - 1).alias("level")
    levels = {r["level"]: r["count"] for r in counts.groupBy(level).count().collect()}  # at most 63 rows
    low = FEW.bit_length() - 1
    while sum(c for at, c in levels.items() if at >= low) > MOST_WORDS:
        low += 1
    got = counts.where(F.col("n") >= 1 << low).toArrow()
    words, n = got.column("word").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(words)
    return words[order], n[order]


def _sketches(values: np.ndarray, row: np.ndarray, rows: int, lanes: int) -> np.ndarray:
    """Parity sketches: one bit of a row is flipped by each of its words."""
    bits = 64 * lanes
    bit = ((values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (bits - 1)
    flat = np.bincount(row * bits + bit, minlength=rows * bits).astype(np.uint8) & 1
    return np.packbits(flat.reshape(rows, bits), axis=1, bitorder="little").view(np.uint64)


def _prefixes(common, threshold: float, wide_only: bool = False):
    """From (key, words) to one row for each word of a class's prefix, with the class's sketch.

    ``wide_only`` gives no more than the words and kinds of blocks that may exceed a cell, to count them.
    """

    def blocked(keys: pa.Array, values: np.ndarray, n: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
        names, counts = common.value
        row = np.repeat(np.arange(len(n)), n)
        if len(names):
            at = np.minimum(np.searchsorted(names, values), len(names) - 1)
            seen = np.where(names[at] == values, counts[at], 0)
        else:
            seen = np.zeros(len(values), np.int64)
        order = np.lexsort((values, seen, row))
        place = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
        keep = np.ceil(threshold * n - 1e-9).astype(np.int64)
        taken = order[place < np.repeat(n - keep + 1, n)]
        if wide_only:
            word = values[taken][seen[taken] > CELL_ROWS]
            yield pa.record_batch([pa.array(word), pa.array(np.full(len(word), kind, np.int32))], ["word", "kind"])
            return
        who, word = row[taken], values[taken]
        sketch = _sketches(values, row, len(n), LANES[kind])
        part = ((sketch[:, 0] ^ sketch[:, 1]) & np.uint64(2**31 - 1)).astype(np.int64)
        wide = LANES[kind] * 8
        for lo in range(0, len(who), 50_000):
            at = who[lo : lo + 50_000]
            bits = pa.FixedSizeBinaryArray.from_buffers(pa.binary(wide), len(at), [None, pa.py_buffer(np.ascontiguousarray(sketch[at]))])
            yield pa.record_batch(
                [pa.array(word[lo : lo + 50_000]), pa.array(np.full(len(at), kind, np.int32)), pa.array(part[at]), keys.take(pa.array(at)), pa.array(n[at].astype(np.int32)), bits.cast(pa.binary())],
                ["word", "kind", "part", "key", "n", "sketch"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column("words")
            values, n = np.asarray(words.flatten()), np.diff(np.asarray(words.offsets)).astype(np.int64)
            row = np.repeat(n, n)
            for kind, chosen in enumerate((n <= LONG, n >= math.floor(threshold * LONG))):
                if chosen.any():
                    inside = row <= LONG if kind == 0 else row >= math.floor(threshold * LONG)
                    yield from blocked(b.column("key").filter(pa.array(chosen)), values[inside], n[chosen], kind)

    return run


def _in_cells(classes: DataFrame, common, threshold: float) -> DataFrame:
    """``(word, cell, key, n, sketch)``: the prefixes, those of blocks over ``CELL_ROWS`` once for each cell they are compared with.

    Bits of ``cell``: the lower and the higher of two cells, 20 each, the kind, and in blocks of several cells the side.
    """
    entries = classes.mapInArrow(_prefixes(common, threshold), "word long, kind int, part long, key binary, n int, sketch binary")
    plain = (F.col("kind") * 2).cast("long").alias("cell")
    if not len(common.value[1]) or common.value[1].max() <= CELL_ROWS:
        return entries.select("word", plain, "key", "n", "sketch")
    sizes = classes.mapInArrow(_prefixes(common, threshold, wide_only=True), "word long, kind int").groupBy("word", "kind").agg(F.count("*").alias("rows"))
    sizes = stored(sizes.where(F.col("rows") > CELL_ROWS).select("word", "kind", F.ceil(F.col("rows") / CELL_ROWS).cast("long").alias("cells")))
    blocks = sizes.count()
    if not blocks:
        return entries.select("word", plain, "key", "n", "sketch")
    cut = entries.join(F.broadcast(sizes) if blocks <= MOST_BLOCKS else sizes, ["word", "kind"], "left").withColumn("cells", F.coalesce("cells", F.lit(1).cast("long")))
    cut = cut.withColumn("own", F.pmod("part", "cells")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = ((F.col("own") == high) & (low != high)).cast("long")
    return cut.select("word", (F.shiftleft(low, 22) + F.shiftleft(high, 2) + F.col("kind") * 2 + side).alias("cell"), "key", "n", "sketch")


def _compare(block: np.ndarray, side: np.ndarray, sketch: np.ndarray, n: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within one block whose sketches lie within the radius; rows come sorted by (block, population count).

    ``side`` is 0 in blocks of one cell, else 2 or 3: only rows of different sides are then compared.
    """
    pops = np.bitwise_count(sketch).sum(1).astype(np.int64)
    rows = len(block)
    tiles = -(-rows // TILE)
    first = np.arange(tiles) * TILE
    last = np.minimum(first + TILE, rows) - 1
    near_n = np.maximum.reduceat(n, first)
    left, right = [np.arange(tiles)], [np.arange(tiles)]
    live = np.arange(tiles)
    for step in range(1, tiles):
        live = live[live + step < tiles]
        live = live[block[last[live]] == block[first[live + step]]]
        if not len(live):
            break
        # within the shared block the counts of the later tile start where those of the earlier one end
        reach = (pops[first[live + step]] - pops[last[live]]) <= ratio * (near_n[live] + near_n[live + step])
        left.append(live[reach])
        right.append(live[reach] + step)
    left, right = np.concatenate(left), np.concatenate(right)
    found_a, found_b = [], []
    lane = np.arange(TILE)
    for lo in range(0, len(left), 256):
        i, j = first[left[lo : lo + 256]], first[right[lo : lo + 256]]
        a, b = np.minimum(i[:, None] + lane, rows - 1), np.minimum(j[:, None] + lane, rows - 1)
        far = np.bitwise_count(sketch[a][:, :, None, 0] ^ sketch[b][:, None, :, 0]).astype(np.int16)
        for k in range(1, sketch.shape[1]):
            far += np.bitwise_count(sketch[a][:, :, None, k] ^ sketch[b][:, None, :, k])
        ok = far <= ratio * (n[a][:, :, None] + n[b][:, None, :]) + 1e-9
        ok &= block[a][:, :, None] == block[b][:, None, :]
        ok &= (i[:, None] + lane)[:, :, None] < (j[:, None] + lane)[:, None, :]
        ok &= ((j[:, None] + lane) < rows)[:, None, :]
        t, x, y = np.nonzero(ok)
        found_a.append(a[t, x])
        found_b.append(b[t, y])
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    both = (side[a] == 0) | (side[a] != side[b])
    return a[both], b[both]


def _pairs(ratio: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
            t = t.combine_chunks()
            word, cell, size = (t.column(c).to_numpy() for c in ("word", "cell", "n"))
            pair = cell >> 2
            block = np.cumsum(np.concatenate([[True], (word[1:] != word[:-1]) | (pair[1:] != pair[:-1])]))
            keys, sketches = t.column("key").combine_chunks(), t.column("sketch").combine_chunks()
            for kind, lanes in enumerate(LANES):
                at = np.flatnonzero((cell >> 1 & 1) == kind)
                at = at[np.bincount(block[at])[block[at]] > 1] if len(at) else at
                if not len(at):
                    continue
                sketch = np.frombuffer(b"".join(sketches.take(pa.array(at)).to_pylist()), np.uint64).reshape(-1, lanes)
                order = np.lexsort((np.bitwise_count(sketch).sum(1), block[at]))
                at, sketch = at[order], np.ascontiguousarray(sketch[order])
                one = (pair[at] >> 20) == (pair[at] & ((1 << 20) - 1))
                n = size[at].astype(np.int64)
                a, b = _compare(block[at], np.where(one, 0, 2 + (cell[at] & 1)), sketch, n, ratio)
                mine = (np.maximum(n[a], n[b]) > LONG) == kind
                a, b = at[a[mine]], at[b[mine]]
                if len(a):
                    yield pa.record_batch([keys.take(pa.array(a)), keys.take(pa.array(b))], ["x", "y"])

        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            if t.num_rows < 200_000:
                rest = t
                continue
            word, pair = t.column("word").to_numpy(), t.column("cell").to_numpy() >> 2
            same = (word == word[-1]) & (pair == pair[-1])
            cut = len(word) - int(np.argmin(same[::-1])) if not same.all() else 0
            rest = t.slice(cut)
            if cut:
                yield from found(t.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield from found(rest)

    return run


def similar_classes(classes: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``(key_a, key_b, shared, size_a, size_b)``: each pair of classes whose word sets are at least ``threshold`` similar."""
    common = classes.sparkSession.sparkContext.broadcast(_common_words(classes))
    ratio = (1 - threshold) / (1 + threshold)
    entries = _in_cells(classes, common, threshold)
    block = ("word", F.expr("shiftright(cell, 2)"))
    near = entries.repartition(*block).sortWithinPartitions(*block).mapInArrow(_pairs(ratio), "x binary, y binary")
    near = stored(near.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct())
    both = near.join(classes.select(F.col("key").alias("key_a"), F.col("words").alias("a")), "key_a")
    both = both.join(classes.select(F.col("key").alias("key_b"), F.col("words").alias("b")), "key_b")
    out = both.select("key_a", "key_b", F.size(F.array_intersect("a", "b")).alias("shared"), F.size("a").alias("size_a"), F.size("b").alias("size_b"))
    return out.where(F.col("shared") >= threshold * (F.col("size_a") + F.col("size_b") - F.col("shared")) - 1e-9)


def near_duplicate_pairs(df: DataFrame, id_col: str = "id", text_col: str = "text", threshold: float = 0.8, min_words: int = 25) -> DataFrame:
    """Every pair of different ids whose texts are at least ``threshold`` similar: ``(id_a, id_b)``, ``id_a < id_b``.

    Null ids and null, empty or short texts (under ``min_words`` different words) take no part; a repeated row counts once;
    an id with several texts is linked by each of them.  An empty table gives no rows; other columns are ignored.
    """
    members, classes = classes_of(df, id_col, text_col, min_words)
    links = similar_classes(classes, threshold).select("key_a", "key_b")
    a, b = members.select(F.col("key").alias("key_a"), F.col("id").alias("i")), members.select(F.col("key").alias("key_b"), F.col("id").alias("j"))
    across = links.join(a, "key_a").join(b, "key_b").where("i <> j").select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))
    crowded = members.groupBy("key").count().where("count > 1").select("key")
    copies = members.join(crowded, "key", "left_semi")
    same = copies.select("key", F.col("id").alias("id_a")).join(copies.select("key", F.col("id").alias("id_b")), "key").where("id_a < id_b").select("id_a", "id_b")
    return across.unionByName(same).distinct()


def components(edges: DataFrame, a: str = "key_a", b: str = "key_b", max_rounds: int | None = None) -> DataFrame:
    """``(node, root)`` of the connected components of an edge table, by alternating large-star and small-star rounds.

    Each round is a distributed group-by and is written to the shared folder; stops when a round changes nothing.
    With ``max_rounds`` an error is raised when the last of them still changed edges.
    """
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    rounds = 0
    while True:
        if rounds == max_rounds:
            raise RuntimeError(f"components haven't settled after {rounds} rounds")
        rounds += 1
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(floor, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(floor.select("u", F.col("m").alias("v"))).distinct()
        )
        after = stored(small)
        if after.exceptAll(now).isEmpty() and now.exceptAll(after).isEmpty():
            break
        now = after
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def near_duplicate_groups(df: DataFrame, id_col: str = "id", text_col: str = "text", threshold: float = 0.8, min_words: int = 25) -> DataFrame:
    """One row per id: ``(id, group_id, copies, links)``.

    ``group_id`` is the smallest id of the group that links of ``threshold`` or more connect, ``copies`` how many ids have
    the same word set and ``links`` to how many other word sets this one is linked.  Ids with short texts are left out.
    """
    members, classes = classes_of(df, id_col, text_col, min_words)
    links = stored(similar_classes(classes, threshold).select("key_a", "key_b"))
    degree = links.select(F.explode(F.array("key_a", "key_b")).alias("key")).groupBy("key").agg(F.count("*").alias("links"))
    roots = components(links).withColumnRenamed("node", "key")
    sized = members.groupBy("key").agg(F.count("*").alias("copies"), F.min("id").alias("first"))
    known = sized.join(roots, "key", "left").join(degree, "key", "left").select("key", "copies", "first", F.coalesce("root", "key").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    known = stored(known)
    named = known.groupBy("root").agg(F.min("first").alias("group_id"))
    return members.join(known, "key").join(named, "root").select("id", "group_id", "copies", "links")


def prefix_length(n: int, threshold: float) -> int:
    """How many of a set's ``n`` words, rarest first, are blocked on."""
    return n - math.ceil(threshold * n - 1e-9) + 1
