"""Filling chunks of fixed capacity with files.

Hierarchical packing in several lengths. Files are routed by size to tiers whose windows are the capacity and a quarter, a
sixteenth and so on of it (TIERS in all); a file over the capacity is cut at it, and what is left over is routed like any
other. As many long windows are opened as the bytes need, and dealt to step groups of GROUP each. The longest tier is packed
best-fit by falling size, then every shorter tier into the gaps that the longer ones leave, each file into the group with most
room, so that the groups keep as much room as each other. The shortest tier, which has most of the files, is dealt to the
groups, as many files to each. What finds no room in its group fills a gap of any other, or opens a window. So groups are alike
in bytes and in files.

At scale the files are spread by hash over shards of a bounded number of rows; a shard is one task's work. The chunks that a
shard can't fill well, one or two, go back as single files, which are spread over fewer shards and packed once more. The
number of shards follows from counts alone (a few rows on the driver).

Defined results: a file counts once, by its latest row (by size where two are as late); a null, zero or negative size counts
as 1; rows without an id are left out; an empty table gives no row. A file over the capacity has a row per part.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from heapq import heapify, heapreplace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

CAPACITY = 4_194_304
#: Rows of a shard, and chunks that it should fill at least so that its last one matters little.
SHARD_ROWS = 100_000
SHARD_CHUNKS = 64
#: Tiers, each a quarter as long as the one before; the last has no lower bound.
TIERS = 5
GROUP = 8
#: How much the files of two groups may differ, and how many more windows than the bytes need are tried for it.
EVEN, SLACK = 1.2, (0.0, 0.002, 0.004, 0.006)
#: A shard's chunks that are filled less than this are packed again with those of others.
WELL_FILLED = 0.99


def tiers_of(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The tier of each size up to the capacity: 0 for those over a quarter of it, and so on."""
    bounds = np.array([capacity // 4**t for t in range(TIERS - 1, 0, -1)], np.int64)
    return TIERS - 1 - np.searchsorted(bounds, sizes, "left")


class _Gaps:
    """Windows by their free bytes."""

    def __init__(self, gaps: list[tuple[int, int]]) -> None:
        self.gaps = sorted(gaps)

    def place(self, size: int) -> int | None:
        """The window with the least room that is enough, or None."""
        at = bisect_left(self.gaps, (size, -1))
        if at == len(self.gaps):
            return None
        free, window = self.gaps.pop(at)
        if free > size:
            insort(self.gaps, (free - size, window))
        return window


def pack(ids: np.ndarray, sizes: np.ndarray, capacity: int = CAPACITY, group: int = GROUP) -> tuple[np.ndarray, ...]:
    """(place of the item, part number, bytes, tier, chunk number, step group) of every part; chunks and groups count from 0. ids break ties.

    The windows that the bytes need are tried first; where the groups then differ in files by more than EVEN, a few more (SLACK).
    """
    if not len(sizes):
        return (np.zeros(0, np.int64),) * 6
    tried = []
    for slack in SLACK:
        out = _packed(ids, sizes, capacity, group, -(-int(sizes.sum() * (1 + slack)) // capacity))
        files = np.bincount(out[5])
        tried.append((files.max() / max(1, files.min()), out))
        if tried[-1][0] < EVEN:
            break
    return min(tried, key=lambda x: x[0])[1] if tried[-1][0] < EVEN else tried[0][1]


def _packed(ids: np.ndarray, sizes: np.ndarray, capacity: int, group: int, windows: int) -> tuple[np.ndarray, ...]:
    full = (sizes - 1) // capacity  # parts that are a chunk each
    rest = sizes - full * capacity
    whole = np.repeat(np.arange(len(sizes)), full)
    nth = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
    order = np.lexsort((ids, -rest))
    tier = tiers_of(rest, capacity)
    chunk = np.full(len(sizes), -1, np.int64)

    # windows and their groups; full parts take theirs first
    used = max(len(whole), windows)
    groups = max(1, -(-used // group))
    of = (np.arange(used) % groups).tolist()
    gaps = [_Gaps([(capacity, w) for w in range(g, used, groups) if w >= len(whole)]) for g in range(groups)]
    free = [(-capacity * len(x.gaps), g) for g, x in enumerate(gaps)]
    heapify(free)

    turn = 0
    for t in range(TIERS):
        over = []
        for i in order[tier[order] == t].tolist():
            n = int(rest[i])
            if t < TIERS - 1:
                room, g = free[0]
                heapreplace(free, (room + n, g))
            else:
                # the shortest there and back, so that each group gets as many files, and as large ones
                g = turn % (2 * groups)
                g = g if g < groups else 2 * groups - 1 - g
                turn += 1
            if (w := gaps[g].place(n)) is None:
                over.append(i)
            else:
                chunk[i] = w
        if over:
            every = _Gaps([x for g in gaps for x in g.gaps])
            for i in over:
                n = int(rest[i])
                if (w := every.place(n)) is None:
                    w = len(of)
                    of.append(w % groups)
                    if n < capacity:
                        insort(every.gaps, (capacity - n, w))
                chunk[i] = w
            parted: list[list[tuple[int, int]]] = [[] for _ in range(groups)]
            for x in every.gaps:
                parted[of[x[1]]].append(x)
            gaps = [_Gaps(x) for x in parted]
    of = np.array(of, np.int64)
    item = np.concatenate([whole, np.arange(len(sizes))])
    # windows that nothing came into are left out
    there, at = np.unique(np.concatenate([np.arange(len(whole)), chunk]), return_inverse=True)
    of = np.unique(of[there], return_inverse=True)[1]
    return item, np.concatenate([nth, full]), np.concatenate([np.full(len(whole), capacity, np.int64), rest]), np.concatenate([np.zeros(len(whole), np.int64), tier]), at, of[at]


def _sharded(items: DataFrame, shards: int, capacity: int, again: bool) -> DataFrame:
    """Each shard packed by itself; `left` marks what is to be packed again. items: file_id, part_no, size, keeps."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids, first = rows["file_id"].to_numpy(), rows["part_no"].to_numpy()
        item, part, size, tier, chunk, step = pack(ids, rows["size"].to_numpy(np.int64), capacity)
        fill = np.bincount(chunk, size)
        poor = (fill < WELL_FILLED * capacity) if again else np.zeros(len(fill), bool)
        number = np.cumsum(~poor) - 1
        groups = np.unique(step[~poor[chunk]], return_inverse=True)
        regrouped = np.zeros(len(step), np.int64)
        regrouped[~poor[chunk]] = groups[1]
        return pd.DataFrame({"file_id": ids[item], "part_no": first[item] + part, "n_bytes": size, "tier": tier, "shard": key[0], "left": poor[chunk], "chunk": number[chunk], "step": regrouped, "chunks": int((~poor).sum()), "steps": len(groups[0])})

    placed = items.withColumn("shard", F.pmod(F.xxhash64("file_id", "part_no"), F.lit(shards)))
    return placed.groupBy("shard").applyInPandas(run, "file_id bigint, part_no bigint, n_bytes bigint, tier bigint, shard bigint, left boolean, chunk bigint, step bigint, chunks bigint, steps bigint")


def latest_sizes(scanned: DataFrame) -> DataFrame:
    """(file_id, size): each file once, by its latest row."""
    size = F.greatest(F.coalesce(F.col("size_bytes"), F.lit(1)), F.lit(1)).cast("bigint")
    newest = F.max(F.struct(F.col("scanned_at"), size.alias("size")))
    return scanned.where("file_id is not null").groupBy("file_id").agg(newest.alias("newest")).select("file_id", F.col("newest.size").alias("size"))


def pack_files(scanned: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(file_id, part_no, n_bytes, tier, chunk_no, step_group): chunks and groups count from 1 without gaps, tiers from 0, the longest.

    scanned: file_id, size_bytes, scanned_at.
    """
    files = latest_sizes(scanned)
    seen = files.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size").cast("decimal(38,0)")).alias("bytes")).first()
    n, total = seen["n"], int(seen["bytes"] or 0)
    by_bytes = total // (capacity * SHARD_CHUNKS)
    # as many shards as the rows need, and more only where each still fills many chunks
    shards = max(1, -(-n // SHARD_ROWS), min(by_bytes, n // 20_000))
    items = files.select("file_id", F.lit(0).cast("bigint").alias("part_no"), "size")
    packed = _sharded(items, shards, capacity, shards > 1)
    if shards == 1:
        return packed.selectExpr("file_id", "part_no", "n_bytes", "tier", "chunk + 1 as chunk_no", "step + 1 as step_group")
    packed = cut(packed)
    left = packed.where("left").selectExpr("file_id", "part_no", "n_bytes as size")
    rows = left.count()
    fewer = max(1, -(-rows // SHARD_ROWS))
    both = packed.where("not left").withColumn("turn", F.lit(0)).unionByName(cut(_sharded(left, fewer, capacity, False)).withColumn("turn", F.lit(1)))
    # one row a shard: what is numbered in one place is bounded by rows / SHARD_ROWS and bytes / SHARD_CHUNKS chunks
    before = Window.orderBy("turn", "shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = both.groupBy("turn", "shard").agg(F.max("chunks").alias("chunks"), F.max("steps").alias("steps")).select(
        "turn", "shard", F.coalesce(F.sum("chunks").over(before), F.lit(0)).alias("first"), F.coalesce(F.sum("steps").over(before), F.lit(0)).alias("first_step")
    )
    return both.join(starts, ["turn", "shard"]).selectExpr("file_id", "part_no", "n_bytes", "tier", "first + chunk + 1 as chunk_no", "first_step + step + 1 as step_group")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(n_chunks, n_parts, n_bytes, fewest_chunks, fill): fewest_chunks is the bound that the bytes alone give."""
    chunks = packed.groupBy("chunk_no").agg(F.count(F.lit(1)).alias("parts"), F.sum("n_bytes").alias("bytes"))
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("parts").alias("n_parts"), F.sum("bytes").alias("n_bytes")).selectExpr(
        "n_chunks", "n_parts", "n_bytes", f"cast(ceil(n_bytes / {capacity}) as bigint) as fewest_chunks", f"round(n_bytes / (n_chunks * {capacity}), 6) as fill"
    )



def tier_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(tier, window, n_parts, n_bytes, n_chunks): how much of each tier there is and in how many chunks it lies."""
    rows = packed.groupBy("tier", "chunk_no").agg(F.count(F.lit(1)).alias("parts"), F.sum("n_bytes").alias("bytes"))
    window = F.expr(f"cast({capacity} / pow(4, tier) as bigint)")
    return rows.groupBy("tier").agg(F.sum("parts").alias("n_parts"), F.sum("bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_chunks")).select("tier", window.alias("window"), "n_parts", "n_bytes", "n_chunks")


def group_report(packed: DataFrame) -> DataFrame:
    """(step_group, n_chunks, n_parts, n_bytes) of every step group."""
    rows = packed.groupBy("step_group", "chunk_no").agg(F.count(F.lit(1)).alias("parts"), F.sum("n_bytes").alias("bytes"))
    return rows.groupBy("step_group").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("parts").alias("n_parts"), F.sum("bytes").alias("n_bytes"))
