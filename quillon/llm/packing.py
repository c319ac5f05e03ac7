"""Filling fixed-capacity containers with items, planned on the histogram of their sizes.

Shallow combinations of sizes that fill a container (one, two or three different sizes, each some times) are enumerated; the
numbers of times to use each are the non-negative least-squares solution that uses up the histogram.  They are rounded down,
and what is left is packed greedily, largest size first, each time repeating the pattern as often as its sizes last.

The plan never sees an item: the histogram has at most ``capacity`` sizes, and the plan a few rows per size.  Items find their
container by the rank they have among the items of their size, which is counted in salted groups.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.tokens import DEFAULT_VOCABULARY, with_token_counts
from quillon.session import stored

#: The histogram, and so the plan, is bounded by the capacity; larger ones are refused.
MAX_CAPACITY = 1 << 20
#: Sizes, the most frequent ones, that combinations begin with; items of other sizes join as partners or in the greedy rest.
LEADERS = 1_200
#: Items of one size that one task ranks together.
RANK_GROUP = 200_000


def nnls(columns: list[list[tuple[int, int]]], target: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares ``min |A x - target|`` for sparse non-negative columns, by multiplicative updates."""
    row = np.array([r for c in columns for r, _ in c])
    val = np.array([v for c in columns for _, v in c], float)
    col = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    size = len(columns)
    want = np.bincount(col, val * target[row], size)
    x = np.full(size, max(target.sum() / max(1.0, val.sum()), 1e-9))
    for _ in range(rounds):
        made = np.bincount(row, val * x[col], len(target))
        x *= want / np.maximum(np.bincount(col, val * made[row], size), 1e-12)
    return x


def combinations(sizes: np.ndarray, counts: np.ndarray, capacity: int, partners: int = 10) -> list[list[tuple[int, int]]]:
    """Candidate patterns as (index of a size, times) lists that fill ``capacity`` to within a hundredth."""
    order = sizes.tolist()
    slack = max(1, capacity // 100)
    some = sorted({int(i) for i in np.linspace(0, len(order) - 1, partners)} | {int(i) for i in np.argsort(-counts)[:partners]})
    out: dict[tuple, None] = {}

    def close(parts: list[tuple[int, int]], room: int) -> None:
        at = bisect_right(order, room) - 1
        if room <= slack:
            found = parts
        elif at < 0:
            return
        else:
            times = room // order[at]
            if room - times * order[at] > slack:
                return
            found = [*parts, (at, times)]
        merged: dict[int, int] = {}
        for i, t in found:
            merged[i] = merged.get(i, 0) + t
        if all(counts[i] >= t for i, t in merged.items()):
            out[tuple(sorted(merged.items()))] = None

    leaders = np.argsort(-counts, kind="stable")[:LEADERS].tolist()
    for i in sorted(leaders, reverse=True):
        most = capacity // order[i]
        for times in sorted({t for t in (1, 2, 3, most // 3, most // 2, most) if 1 <= t <= most}):
            room = capacity - times * order[i]
            close([(i, times)], room)
            for j in some:
                fit = room // order[j]
                for again in {t for t in (1, fit // 2, fit) if 1 <= t <= fit}:
                    close([(i, times), (j, again)], room - again * order[j])
    return [list(p) for p in out]


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """``[(pattern, repeats)]`` that together use every item; ``histogram[s]`` items have size ``s``; a pattern lists (size, times)."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    sizes = np.flatnonzero(left)
    out: list[tuple[list[tuple[int, int]], int]] = []
    if not len(sizes):
        return out
    columns = combinations(sizes, left[sizes], capacity)
    if columns:
        x = nnls(columns, left[sizes].astype(float))
        for k in np.argsort(-x):
            if x[k] < 1:
                break
            pattern = [(int(sizes[i]), t) for i, t in columns[k]]
            repeats = min(int(x[k]), *(int(left[s] // t) for s, t in pattern))
            if repeats > 0:
                for s, t in pattern:
                    left[s] -= repeats * t
                out.append((pattern, repeats))
    order = np.flatnonzero(left).tolist()
    while order:
        room, pattern, top = capacity, [], len(order) - 1
        while top >= 0:
            s = order[top]
            times = min(room // s, int(left[s]))
            if times:
                pattern.append((s, times))
                room -= times * s
            top = min(top - 1, bisect_right(order, room) - 1)
        repeats = min(int(left[s] // t) for s, t in pattern)
        for s, t in pattern:
            left[s] -= repeats * t
        out.append((pattern, repeats))
        order = [s for s in order if left[s]]
    return out


def _ranked(items: DataFrame, total: int) -> DataFrame:
    """Items with their rank (from 0) within (window_name, size), counted in salted groups; the order is by id and piece."""
    salts = 1 + total // RANK_GROUP
    keyed = items.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)))
    before = Window.partitionBy("window_name", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("window_name", "size", "salt").agg(F.count("*").alias("c")).withColumn("base", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    inside = Window.partitionBy("window_name", "size", "salt").orderBy("id", "piece")
    numbered = keyed.withColumn("inner", F.row_number().over(inside) - 1)
    if salts == 1:
        return numbered.withColumn("rank", F.col("inner").cast("long")).drop("salt", "inner")
    return numbered.join(counts, ["window_name", "size", "salt"]).withColumn("rank", F.col("base") + F.col("inner")).drop("salt", "inner", "base")


def pack(sized: DataFrame, windows: list[tuple[str, int]], id_col: str, size_col: str) -> DataFrame:
    """``(window_name, capacity, container, id, piece, start, size, offset)``: where each piece of each item lies, for every window.

    An item over the capacity is cut into full pieces and a rest (``start`` says where); no other is divided.  Items of size 0
    or null are in no container.  Rows that repeat an id with the same size count once.
    """
    for name, capacity in windows:
        if not 0 < capacity <= MAX_CAPACITY:
            raise ValueError(f"capacity of {name} must be between 1 and {MAX_CAPACITY}")
    spark = sized.sparkSession
    items = sized.select(F.col(id_col).alias("id"), F.col(size_col).cast("long").alias("n")).where("n > 0 and id is not null").distinct()
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("window_name"), F.lit(c).cast("long").alias("capacity")) for n, c in windows])).alias("w")
    cut = items.select("id", "n", each).select("id", "w.*", "n", F.explode(F.expr("sequence(0L, (n - 1) div w.capacity)")).alias("piece"))
    cut = cut.select("window_name", "capacity", "id", "piece", (F.col("piece") * F.col("capacity")).alias("start"), F.least(F.col("capacity"), F.col("n") - F.col("piece") * F.col("capacity")).alias("size"))
    # at most the sum of the capacities rows
    got = cut.groupBy("window_name", "size").count().toPandas()
    number = {n: k for k, (n, _) in enumerate(windows)}
    keys, first, times, offset = [], [], [], []
    for name, capacity in windows:
        mine = got[got["window_name"] == name]
        histogram = np.zeros(capacity + 1, np.int64)
        histogram[mine["size"].to_numpy()] = mine["count"].to_numpy()
        used = np.zeros(capacity + 1, np.int64)
        container = 0
        for pattern, repeats in plan(histogram, capacity):
            at = 0
            for s, t in pattern:
                keys.append((number[name], s, int(used[s])))
                first.append(container)
                times.append(t)
                offset.append(at)
                used[s] += t * repeats
                at += s * t
            container += repeats
    shape = np.array([(a, b) for a, b, _ in keys], np.int64).reshape(-1, 2)
    rank0 = np.array([r for _, _, r in keys], np.int64)
    order = np.lexsort((rank0, shape[:, 1], shape[:, 0]))
    group = shape[order, 0] * (MAX_CAPACITY + 1) + shape[order, 1]
    rules = spark.sparkContext.broadcast((number, group, rank0[order], np.array(first, np.int64)[order], np.array(times, np.int64)[order], np.array(offset, np.int64)[order]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, groups, starts, containers, per, offsets = rules.value
        bound = np.append(np.unique(groups, return_index=True)[1], len(groups))
        ids = np.unique(groups)
        for b in batches:
            if not b.num_rows:
                continue
            window = np.array([names[w] for w in b.column("window_name").to_pylist()], np.int64)
            size, rank = b.column("size").to_numpy(), b.column("rank").to_numpy()
            g = np.searchsorted(ids, window * (MAX_CAPACITY + 1) + size)
            # the last rule of the group that starts at or before the rank
            low, high = bound[g], bound[g + 1]
            while (high - low > 1).any():
                mid = (low + high) // 2
                right = starts[mid] <= rank
                wide = high - low > 1
                low = np.where(wide & right, mid, low)
                high = np.where(wide & ~right, mid, high)
            past = rank - starts[low]
            yield pa.record_batch(
                [
                    b.column("window_name"), b.column("capacity"), pa.array(containers[low] + past // per[low]), b.column("id"), b.column("piece"), b.column("start"), b.column("size"),
                    pa.array(offsets[low] + past % per[low] * size),
                ],
                ["window_name", "capacity", "container", "id", "piece", "start", "size", "offset"],
            )

    kind = sized.schema[id_col].dataType.simpleString()
    ranked = _ranked(cut, int(got["count"].sum()))
    columns = ["window_name", "capacity", "id", "piece", "start", "size", "rank"]
    return ranked.select(columns).mapInArrow(place, f"window_name string, capacity long, container long, id {kind}, piece long, start long, size long, offset long")


def pack_texts(df: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_col: str = "window_name", capacity_col: str = "capacity_tokens", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Texts packed by their tokens into windows of each capacity; ``windows`` is a small fixed table (at most 1,000 rows)."""
    sizes = stored(with_token_counts(df, [id_col], text_col, vocabulary))
    chosen = windows.select(name_col, capacity_col).where(f"{name_col} is not null and {capacity_col} > 0").distinct().orderBy(name_col).limit(1001).collect()
    if len(chosen) > 1000:
        raise ValueError("more than 1,000 windows")
    if not chosen:
        raise ValueError("no window with a capacity")
    return pack(sizes, [(r[0], int(r[1])) for r in chosen], id_col, "n_tokens").withColumnRenamed("id", id_col)


def fill_report(packed: DataFrame) -> DataFrame:
    """``(window_name, capacity, containers, tokens, filled)`` of a packing; ``filled`` is the share of the room that is used."""
    per = packed.groupBy("window_name", "capacity", "container").agg(F.sum("size").alias("used"))
    out = per.groupBy("window_name", "capacity").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"))
    return out.withColumn("filled", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))
