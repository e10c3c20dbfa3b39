"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Method: every shard stands at vnodes places of a ring of 64-bit hashes. A text's hash names one of
2^bits places of the ring, so equal texts stand at one place, and a place is what moves. Its shard
is that of the next virtual node clockwise; a shard takes a place only while its bytes stay within
(1 + slack) of an even share, and a place that finds its shard full goes on clockwise to the first
that has room. Places are dealt in a fixed order, by size class from the largest down and then by
hash, so the same table gives the same shards. A place for which no shard has room, which happens
to a few small ones at the end and to texts larger than a shard, goes to the emptiest shard.
With the default slack of 0 every shard is full, so sizes differ by about the smallest places.

A group of equal texts above SPLIT of a shard's share (there are fewer than shards / SPLIT of them)
is dealt by id into pieces of half that size, each with a place of its own; all other groups stay
whole in one shard. Rows of such a group that share an id also share a piece.

Scale: one pass over the texts keeps 24 bytes a row; bytes are summed by place, map-side, so the
driver walks the ring over at most 2^bits sums and the pieces, whatever the table holds. Placed are
all rows by a broadcast of those 2^bits shards. Slots come from row numbers within BUCKETS parts
of a shard, by a hash of id and text, and prefix sums over the parts, so no task holds a shard.
Texts are read twice; they are shuffled only if the result's text column is read.

Growth: with one more shard its virtual nodes take over their arcs, and full shards pass on what
the smaller share leaves no room for; tests hold the bytes that move to a few times the new share.

Defined results: null text has no bytes, its checksum is that of no bytes, and all nulls are one
group; an empty table gives no rows; rows that repeat an id and text are ordered arbitrarily among
themselves; extra columns pass through, but for those whose name starts with _shard_, which are dropped.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.llm.text import all_of, named, without_reserved
from lodestone.runtime import Scratch

SHARDS = 40
VNODES = 256
#: Places of the ring for each shard at least; their number is a power of two.
PLACES = 1_024
#: Groups of equal texts above this share of a shard are dealt into pieces of half of it.
SPLIT = 0.5
#: Parts in which a shard's rows are numbered.
BUCKETS = 4_096
#: What each row counts besides its bytes.
ROW_BYTES = 16


def _hash(name: str) -> int:
    return int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big")


class Ring:
    """Shards at their virtual nodes."""

    def __init__(self, shards: int, vnodes: int = VNODES) -> None:
        if shards < 1 or vnodes < 1:
            raise ValueError("a ring needs shards and virtual nodes")
        self.shards = shards
        nodes = sorted((_hash(f"{s}:{v}"), s) for s in range(shards) for v in range(vnodes))
        self.at, self.shard = [a for a, _ in nodes], [s for _, s in nodes]

    def clockwise(self, position: int):
        """The shards from a position on, as their virtual nodes follow."""
        first = bisect_left(self.at, position)
        for i in range(len(self.at)):
            yield self.shard[(first + i) % len(self.at)]

    def place(self, sizes: dict[str, tuple[int, int]], slack: float = 0.0) -> dict[str, int]:
        """sizes: name -> (position, bytes). The shard of each name, under bounded loads."""
        room = [sum(b for _, b in sizes.values()) / self.shards * (1 + slack)] * self.shards
        out = {}
        for name in sorted(sizes, key=lambda n: (-sizes[n][1].bit_length(), _hash(n), n)):
            position, size = sizes[name]
            shard = next((s for s in self.clockwise(position) if room[s] >= size), None) if max(room) >= size else None
            if shard is None:
                shard = max(range(self.shards), key=lambda s: (room[s], -s))
            room[shard] -= size
            out[name] = shard
        return out


def place_bits(shards: int) -> int:
    """Bits of a place's number for so many shards."""
    return max(8, (shards * PLACES - 1).bit_length())


class Placement:
    """Which shard holds which place of the ring and which piece of a hot group."""

    def __init__(self, bits: int, places: dict[int, int], hot: dict[int, int], pieces: dict[tuple[int, int], int]) -> None:
        self.bits, self.places, self.hot, self.pieces = bits, places, hot, pieces

    def of(self, df: DataFrame, group: Column, row: Column) -> DataFrame:
        """df with _shard_id, from a row's group hash and row hash."""
        spark = df.sparkSession
        hot = spark.createDataFrame(list(self.hot.items()), "_shard_g long, _shard_k int")
        parts = [(g, p, s) for (g, p), s in self.pieces.items()]
        whole = [(None, p, s) for p, s in self.places.items()]
        # Hot groups meet their pieces, all others their place; both tables are bounded by the ring.
        shards = spark.createDataFrame(parts + whole, "_shard_g long, _shard_p int, _shard_id int")
        out = df.withColumn("_shard_g", group).join(F.broadcast(hot), "_shard_g", "left")
        piece = F.pmod(row, F.col("_shard_k")).cast("int")
        place = F.shiftrightunsigned(group, 64 - self.bits).cast("int")
        out = out.withColumn("_shard_p", F.when(F.col("_shard_k").isNull(), place).otherwise(piece))
        out = out.withColumn("_shard_g", F.when(F.col("_shard_k").isNotNull(), F.col("_shard_g")))
        on = out["_shard_g"].eqNullSafe(shards["_shard_g"]) & (out["_shard_p"] == shards["_shard_p"])
        return out.join(F.broadcast(shards), on).drop("_shard_g", "_shard_k", "_shard_p")


def text_group(text: Column) -> Column:
    """The hash of a text; equal texts share it. Others that share it only stay together too."""
    return F.xxhash64(text)


def row_hash(row_id: Column, text: Column) -> Column:
    return F.xxhash64(row_id.cast("string"), text_group(text))


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def placement(rows: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, slack: float = 0.0) -> Placement:
    """rows(g, r, size: group hash, row hash, bytes) -> what each shard holds."""
    bits = place_bits(shards)
    at = F.shiftrightunsigned("g", 64 - bits).cast("int")
    sums = {r["p"]: r["size"] for r in rows.groupBy(at.alias("p")).agg(F.sum("size").alias("size")).collect()}
    most = sum(sums.values()) / shards * SPLIT
    heavy = [p for p, size in sums.items() if size > most]
    hot, sizes = {}, {}
    if heavy:
        # Fewer than shards / SPLIT places, groups and, but for rounding, twice as many pieces.
        groups = rows.where(at.isin(heavy)).groupBy("g").agg(F.sum("size").alias("size")).where(F.col("size") > most).collect()
        hot = {r["g"]: -int(-r["size"] // max(1, most / 2)) for r in groups}
    if hot:
        many = F.create_map(*[F.lit(x) for pair in hot.items() for x in pair])[F.col("g")]
        dealt = rows.where(F.col("g").isin(*hot)).groupBy("g", F.pmod("r", many).cast("int").alias("piece"))
        for r in dealt.agg(F.sum("size").alias("size")).collect():
            sizes[f"{r['g']}:{r['piece']}"] = (_hash(f"{r['g']}:{r['piece']}"), r["size"])
            sums[(r["g"] % (1 << 64)) >> (64 - bits)] -= r["size"]
    places = {f"{p}": (p << (64 - bits), size) for p, size in sums.items()}
    found = Ring(shards, vnodes).place(places | sizes, slack)
    pieces = {(int(g), int(p)): found[f"{g}:{p}"] for g, p in (name.split(":") for name in sizes)}
    return Placement(bits, {p: found[f"{p}"] for p in sums}, hot, pieces)


def shard(
    docs: DataFrame, shards: int = SHARDS, *, id_col: str = "doc_id", text_col: str = "text", vnodes: int = VNODES, slack: float = 0.0
) -> DataFrame:
    """docs with _shard_size, _shard_crc32, _shard_id (from 0) and _shard_slot (from 0, gapless in a shard)."""
    spark = docs.sparkSession
    docs = without_reserved(docs, "_shard_")
    g, r = text_group(named(text_col)), row_hash(named(id_col), named(text_col))
    slim = Scratch(spark, "sharding").keep(docs.select(g.alias("g"), r.alias("r"), text_bytes(named(text_col)).alias("size")), "rows")
    plan = placement(slim, shards, vnodes, slack)
    bucket = lambda c: F.pmod(F.shiftright(c, 20), F.lit(BUCKETS)).cast("int")

    # Rows before each bucket of a shard.
    counts = plan.of(slim, F.col("g"), F.col("r")).groupBy("_shard_id", bucket(F.col("r")).alias("_shard_bucket")).agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("_shard_id").orderBy("_shard_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("_shard_start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")

    sized = docs.withColumns({
        "_shard_size": text_bytes(named(text_col)), "_shard_crc32": F.crc32(F.coalesce(named(text_col), F.lit(""))),
        "_shard_row": r, "_shard_group": g,
    })
    placed = plan.of(sized, F.col("_shard_group"), F.col("_shard_row")).withColumn("_shard_bucket", bucket(F.col("_shard_row")))
    order = W.partitionBy("_shard_id", "_shard_bucket").orderBy(named(id_col), "_shard_group")
    placed = placed.withColumn("_shard_at", F.row_number().over(order)).join(starts, ["_shard_id", "_shard_bucket"])
    slot = (F.col("_shard_start") + F.col("_shard_at") - 1).cast("long")
    return placed.select(*all_of(docs), "_shard_size", "_shard_crc32", "_shard_id", slot.alias("_shard_slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write a folder for each shard, its files in the order of slots; large shards are written by many tasks."""
    ranged = sharded.repartitionByRange("_shard_id", "_shard_slot").sortWithinPartitions("_shard_id", "_shard_slot")
    ranged.write.mode("overwrite").partitionBy("_shard_id").parquet(path)
