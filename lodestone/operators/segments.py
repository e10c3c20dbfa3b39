"""Greedy segmentation of ordered groups in parallel: a fold that starts anew at every limit.

A segment starts where the running sum of a segment that is not empty would pass the limit. A row
is known by the sum of its group's rows before it, so where the segment that starts at a row ends
is a look-up of that sum plus the limit, and a group falls into blocks of FAN limits. In each
block, by itself, every row at which the fold may enter it is mapped to where the fold leaves it;
the maps of FAN neighbouring blocks are composed to those of one larger block, until a block holds
the largest group. Then the true entries are followed downwards, level by level, to the starts in
every block. So a group of any size is dealt over many tasks, the work grows in proportion to the
rows, and what a task holds is bounded by FAN limits.

Places are twice a row's sum, and one more for rows that have a size: rows of size 0 stand right
before the row of the same sum. They go with the segment before them, but after a row above the
limit, whose segment takes nothing more, and at a group's start they begin one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.runtime import Scratch, ship_package

#: Limits in a block, and blocks in one of the next level.
FAN = 64
#: What a group's end leads to.
END = np.iinfo(np.int64).max


def running_sums(rows: DataFrame, group: str, order: list[str], size: str, scratch: Scratch) -> DataFrame:
    """rows with _at, the sum of size over the rows of the group before it, and _row, a number of the row.

    Rows are dealt by ranges of their order; each range sums by itself and starts at the sums of those before it.
    """
    ranged = rows.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    ranged = scratch.keep(ranged, "ranged")
    # A row for each range of a group.
    totals = ranged.groupBy("_part", group).agg(F.sum(size).alias("_sum"))
    earlier = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.coalesce(F.sum("_sum").over(earlier(W.partitionBy(group).orderBy("_part"))), F.lit(0))).drop("_sum")
    inside = F.coalesce(F.sum(size).over(earlier(W.partitionBy("_part", group).orderBy(*order, "_row"))), F.lit(0))
    starts = starts.select(F.col("_part").alias("_other"), F.col(group).alias("_their"), "_start")
    both = ranged.withColumn("_inside", inside).join(starts, (F.col("_part") == F.col("_other")) & F.col(group).eqNullSafe(F.col("_their")))
    return both.withColumn("_at", (F.col("_start") + F.col("_inside")).cast("long")).drop("_part", "_inside", "_start", "_other", "_their")


class _Block:
    """Of a block's rows those at which a segment may start, with where the next segment starts.

    kind 0: rows, 1: the end of a group, 2: rows of the next block that a segment may reach, 3: a true entry.
    """

    def __init__(self, t: pa.Table, limit: int, width: int) -> None:
        t = t.filter(pc.less(t["kind"], 3)).sort_by([("at", "ascending"), ("kind", "ascending")])
        at, n, kind = (t[c].to_numpy() for c in ("at", "n", "kind"))
        first = np.concatenate([[True], at[1:] != at[:-1]])
        at, n, kind = at[first], n[first], kind[first]
        # What a row above the limit leads to, and a block's first row, for which the row before is unknown.
        self.after = np.concatenate([[True], n[:-1] > limit]) & (kind < 2)
        keep = (at % 2 == 1) | self.after
        self.at, self.kind, self.after, n = at[keep], kind[keep], self.after[keep], n[keep]
        self.near = self.at % width < 2 * limit + 2
        sized = self.at[self.at % 2 == 1]
        last = sized[np.searchsorted(sized, self.at // 2 * 2 + 2 * limit + 1, "right") - 1]
        self.to = np.where(self.kind == 1, END, np.where(n > limit, self.at // 2 * 2 + 2 * n, last))


def _leave(at: np.ndarray, to: np.ndarray, hops: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the fold leaves the block that ends at end, and after how many segments, from each of these places."""
    out, count, places = to.tolist(), hops.tolist(), np.searchsorted(at, to).tolist()
    for i in range(len(out) - 1, -1, -1):
        if out[i] < end and places[i] > i:
            out[i], count[i] = out[places[i]], count[i] + count[places[i]]
    return np.array(out, np.int64), np.array(count, np.int64)


_MAP = "at long, to long, hops long"


def _map(at: np.ndarray, to: np.ndarray, hops: np.ndarray) -> dict:
    return {"at": pa.array(at, pa.int64()), "to": pa.array(to, pa.int64()), "hops": pa.array(hops, pa.int64())}


def _per_block(df: DataFrame, width: int, fn: Callable[[pa.Table, int], dict], schema: str) -> DataFrame:
    """_g and fn(rows, the block's end) of each block."""
    df = df.withColumn("block", F.coalesce("block", F.expr(f"at div {width}L")) if "block" in df.columns else F.expr(f"at div {width}L"))

    def run(t: pa.Table) -> pa.Table:
        got = fn(t, (t["block"][0].as_py() + 1) * width)
        return pa.table({"_g": pa.array([t["_g"][0].as_py()] * len(next(iter(got.values()))), t.schema.field("_g").type)} | got)

    return df.groupBy("_g", "block").applyInArrow(run, f"_g {df.schema['_g'].dataType.simpleString()}, {schema}")


def segment(rows: DataFrame, *, group: str, order: list[str], size: str, limit: int, fan: int = FAN) -> DataFrame:
    """rows with segment (from 0 in each group). size counts whole units; null and less than 0 count as 0."""
    ship_package(rows.sparkSession)
    scratch = Scratch(rows.sparkSession, "segments")
    names = rows.columns
    plain = rows.withColumn("_n", F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")).withColumnRenamed(group, "_g")
    summed = scratch.keep(running_sums(plain, "_g", order, "_n", scratch), "summed")
    span = 2 * limit * fan
    zero = F.lit(0).cast("long")
    sums = summed.groupBy("_g").agg((F.max(F.col("_at") + F.col("_n")) * 2 + 1).alias("at"))
    most = sums.agg(F.max("at")).first()[0] or 0
    own = summed.select("_g", (F.col("_at") * 2 + (F.col("_n") > 0).cast("int")).alias("at"), F.col("_n").alias("n"), F.lit(0).alias("kind"), F.col("_row").alias("row"))
    own = own.unionByName(sums.select("_g", "at", zero.alias("n"), F.lit(1).alias("kind"), F.lit(-1).cast("long").alias("row")))
    own = own.withColumn("block", F.expr(f"at div {span}L"))
    near = own.where((F.col("at") % 2 == 1) & (F.col("at") % span < 2 * limit + 2) & (F.col("block") > 0))
    leaves = own.unionByName(near.withColumns({"kind": F.lit(2), "block": F.col("block") - 1})).withColumn("batch", zero)

    def enter(t: pa.Table, end: int) -> dict:
        b = _Block(t, limit, span)
        to, hops = _leave(b.at, b.to, (b.kind != 1).astype(np.int64), end)
        first = np.arange(len(b.at)) == 0
        plain = (b.kind < 2) & ((~b.after & b.near) | (first & (b.at % 2 == 1)) | (b.kind == 1))
        pick = np.concatenate([np.flatnonzero(b.after), np.flatnonzero(plain)])
        key = np.concatenate([b.at[b.after] // 2 * 2, b.at[plain]])
        return _map(key, to[pick], hops[pick])

    maps, width = [], span
    if most >= width:
        maps.append(scratch.keep(_per_block(leaves, span, enter, _MAP), "map0"))
    while most >= width * fan:
        width *= fan

        def compose(t: pa.Table, end: int, width: int = width) -> dict:
            t = t.sort_by("at")
            at, to, hops = (t[c].to_numpy() for c in ("at", "to", "hops"))
            out, count = _leave(at, to, hops, end)
            pick = (at % width < 2 * limit + 2) | (at % 2 == 0) | (hops == 0)
            return _map(at[pick], out[pick], count[pick])

        maps.append(scratch.keep(_per_block(maps[-1], width, compose, _MAP), f"map{len(maps)}"))

    def follow(t: pa.Table, end: int) -> dict:
        true, t = t.filter(pc.equal(t["kind"], 3)), t.filter(pc.equal(t["kind"], 0))
        ways = dict(zip(t["at"].to_pylist(), zip(t["to"].to_pylist(), t["hops"].to_pylist(), strict=True), strict=True))
        at, batch = [], []
        for a, b in zip(true["at"].to_pylist(), true["batch"].to_pylist(), strict=True):
            while a in ways:
                at.append(a)
                batch.append(b)
                a, b = ways[a][0], b + ways[a][1]
        return {"at": pa.array(at, pa.int64()), "batch": pa.array(batch, pa.int64())}

    # Every group is entered at 0; where a level's blocks are entered follows from the level above.
    entries = sums.select("_g", zero.alias("at"), zero.alias("batch"))
    for level in range(len(maps) - 1, -1, -1):
        ways = maps[level].withColumns({"kind": F.lit(0), "batch": zero})
        both = ways.unionByName(entries.withColumns({"to": zero, "hops": zero, "kind": F.lit(3)}))
        entries = scratch.keep(_per_block(both, span * fan ** (level + 1), follow, "at long, batch long"), f"entries{level}")

    def assign(t: pa.Table, end: int) -> dict:
        b, true, rows = _Block(t, limit, span), t.filter(pc.equal(t["kind"], 3)), t.filter(pc.equal(t["kind"], 0))
        if not len(rows):  # a block inside one large row, which sees rows of the next one
            return {"row": pa.array([], pa.int64()), "segment": pa.array([], pa.int64())}
        batch, starts = true["batch"][0].as_py(), []
        i = int(np.searchsorted(b.at, true["at"][0].as_py()))
        while i < len(b.at) and b.kind[i] == 0:
            starts.append(b.at[i])
            i = int(np.searchsorted(b.at, b.to[i])) if b.to[i] < end else len(b.at)
        found = batch - 1 + np.searchsorted(np.array(starts, np.int64), rows["at"].to_numpy(), "right")
        return {"row": rows["row"].combine_chunks(), "segment": pa.array(found, pa.int64())}

    true = entries.select("_g", "at", zero.alias("n"), F.lit(3).alias("kind"), zero.alias("row"), F.expr(f"at div {span}L").alias("block"), "batch")
    found = _per_block(leaves.unionByName(true), span, assign, "row long, segment long")
    out = summed.join(found.select(F.col("row").alias("_row"), F.col("segment").cast("int")), "_row")
    return out.withColumnRenamed("_g", group).select(*(F.col(f"`{c}`") for c in names), "segment")
