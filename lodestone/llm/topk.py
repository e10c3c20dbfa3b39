"""Exact top-k search by inner product.

Method: candidates are dealt by similarity, each to the nearest of at most PIVOTS drawn vectors,
and the candidates of a pivot by hash, into shards of bounded size. Each shard becomes a ball
tree (median splits along the direction of widest spread; a node keeps its centre and radius).
Queries are dealt alike into blocks. The shards' roots are kept apart, in pages: for a block and
a page of roots the upper bounds q.c + |q| r tell which shards may hold a result before any of
them is moved. First each block searches the FIRST shards of the highest bounds; the k-th scores
found there are shared with all others: only shards whose bound reaches the k-th score of one of
the block's queries are joined to it and searched, starting with those scores. Inside a shard a
block descends the tree in order of the bound and prunes nodes whose bound is below the current
k-th score; bounds of equal height are kept, since ties go to the smaller id. So exactness costs
one row of two bounded blobs for each block and shard that is not pruned.

Scores are integer inner products of floor(scale * x), exact in 64 bits: floating point is
used where it is exact, Python integers else; a score beyond 64 bits raises an error.

Defined results: vectors that are null, empty or hold null or non-finite components take no
part, nor do null ids; an id that repeats counts once, with its smallest vector; vectors of
another length than the query's are no candidates; fewer than k candidates are all returned;
no candidate means no row; extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.llm.text import named
from lodestone.runtime import Scratch, ship_package

SHARD_ROWS = 8_192
BLOCK_ROWS = 256
LEAF_ROWS = 128
PIVOTS = 2_048
PAGE_ROWS = 4_096
FIRST = 2
SALTS = 64
NONE = np.iinfo(np.int64).min


def build_tree(x: np.ndarray, ids: np.ndarray, leaf: int = LEAF_ROWS) -> dict[str, np.ndarray]:
    """Nodes in depth-first order: rows lo..hi of the permuted shard, centre, radius, skip (the next node past the subtree)."""
    order = np.arange(len(ids))
    xf = x.astype(np.float64)
    lo_, hi_, cen, rad, skip = [], [], [], [], []

    def grow(lo: int, hi: int) -> None:
        me = len(lo_)
        part = xf[order[lo:hi]]
        c = part.mean(axis=0)
        d = part - c
        far = np.sqrt((d * d).sum(axis=1))
        lo_.append(lo), hi_.append(hi), cen.append(c), rad.append(far.max()), skip.append(0)
        if hi - lo > leaf and rad[me] > 0:
            a = part[far.argmax()]
            da = part - a
            b = part[(da * da).sum(axis=1).argmax()]
            mid = (hi - lo) // 2
            o = np.argpartition(part @ (b - a), mid)
            order[lo:hi] = order[lo:hi][o]
            grow(lo, lo + mid)
            grow(lo + mid, hi)
        elif hi - lo > leaf:  # equal vectors: any split will do
            mid = (hi - lo) // 2
            grow(lo, lo + mid)
            grow(lo + mid, hi)
        skip[me] = len(lo_)

    grow(0, len(ids))
    return {"x": x[order], "ids": ids[order], "lo": np.array(lo_), "hi": np.array(hi_), "c": np.array(cen), "r": np.array(rad), "skip": np.array(skip)}


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return np.rint(q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    out = q.astype(object) @ x.astype(object).T
    if out.size and (max(out.flat) >= 2**63 or min(out.flat) < -(2**63)):
        raise OverflowError("an inner product does not fit 64 bits")
    return out.astype(np.int64)


def search(tree: dict, q: np.ndarray, qids: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids), each queries x k, best first; NONE marks empty places. kth: scores already held elsewhere."""
    n = len(q)
    best, who = np.full((n, k), NONE, np.int64), np.zeros((n, k), np.int64)
    kth = kth.copy()
    qf = q.astype(np.float64)
    norm = np.sqrt((qf * qf).sum(axis=1))
    bound = qf @ tree["c"].T + norm[:, None] * tree["r"][None, :]
    bound += 1e-9 * (np.abs(bound) + 1) + 0.5  # over what rounding may take; scores are integers
    leaves = np.flatnonzero(tree["skip"] == np.arange(len(tree["skip"])) + 1)
    # Bounds of ancestors hold for their leaves too: pass the smallest down.
    tight = np.full_like(bound, np.inf)
    for i in range(len(tree["lo"])):
        tight[:, i : tree["skip"][i]] = np.minimum(tight[:, i : tree["skip"][i]], bound[:, i : i + 1])
    for leaf in leaves[np.argsort(-tight[:, leaves].max(axis=0), kind="stable")]:
        on = np.flatnonzero(tight[:, leaf] >= kth)
        if not len(on):
            continue
        x, ids = tree["x"][tree["lo"][leaf] : tree["hi"][leaf]], tree["ids"][tree["lo"][leaf] : tree["hi"][leaf]]
        got = _exact(q[on], x)
        got[qids[on][:, None] == ids[None, :]] = NONE
        got[got < kth[on][:, None]] = NONE
        some = (got > NONE).any(axis=1)
        if not some.any():
            continue
        on, got = on[some], got[some]
        s = np.concatenate([best[on], got], axis=1)
        w = np.concatenate([who[on], np.broadcast_to(ids, got.shape)], axis=1)
        o = np.lexsort((w, -np.maximum(s, NONE + 1)), axis=-1)[:, :k]
        best[on], who[on] = np.take_along_axis(s, o, 1), np.take_along_axis(w, o, 1)
        kth[on] = np.maximum(kth[on], best[on, k - 1])
    return best, who


def _small(a: np.ndarray) -> tuple[bytes, str]:
    for t in ("int8", "int16", "int32"):
        if len(a) == 0 or (a.min() >= np.iinfo(t).min and a.max() <= np.iinfo(t).max):
            return a.astype(t).tobytes(), t
    return a.tobytes(), "int64"


BLOB = "n int, x binary, kind string, ids binary"


def _pack(rows: pa.Table, keys: list[str], dim_at: str = "dim", tree: bool = False) -> pa.RecordBatch:
    ids = rows["id"].to_numpy().astype(np.int64)
    dim = rows[dim_at][0].as_py()
    x = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(ids), dim)
    o = np.argsort(ids, kind="stable")
    x, ids = x[o], ids[o]
    cols = {k: [rows[k][0].as_py()] for k in keys}
    types = [pa.field(k, rows.schema.field(k).type) for k in keys]
    if tree:
        t = build_tree(x, ids)
        x, ids = t["x"], t["ids"]
        nodes = np.stack([t["lo"], t["hi"], t["skip"]]).astype(np.int64)
        cols |= {"nodes": [nodes.tobytes()], "centres": [t["c"].tobytes()], "radii": [t["r"].tobytes()]}
    blob, kind = _small(x.ravel())
    cols |= {"n": [len(ids)], "x": [blob], "kind": [kind], "ids": [ids.tobytes()]}
    binary = [pa.field(c, pa.binary()) for c in ("nodes", "centres", "radii") if tree]
    return pa.RecordBatch.from_pydict(cols, pa.schema([*types, *binary, pa.field("n", pa.int32()), pa.field("x", pa.binary()), pa.field("kind", pa.string()), pa.field("ids", pa.binary())]))


def _shards(t: pa.Table) -> pa.Table:
    return pa.Table.from_batches([_pack(t, ["dim", "shard"], tree=True)])


def _blocks(t: pa.Table) -> pa.Table:
    return pa.Table.from_batches([_pack(t, ["dim", "block"])])


def _array(r: dict, p: str) -> np.ndarray:
    return np.frombuffer(r[f"{p}x"], r[f"{p}kind"]).astype(np.int64).reshape(r[f"{p}n"], r["dim"])


def _search_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = None, None
        for b in batches:
            for i in range(b.num_rows):
                r = {n: b.column(j)[i].as_py() for j, n in enumerate(b.schema.names)}
                if at != (r["dim"], r["shard"]):
                    nodes = np.frombuffer(r["nodes"], np.int64).reshape(3, -1)
                    tree = {"x": _array(r, ""), "ids": np.frombuffer(r["ids"], np.int64), "lo": nodes[0], "hi": nodes[1], "skip": nodes[2],
                            "c": np.frombuffer(r["centres"]).reshape(-1, r["dim"]), "r": np.frombuffer(r["radii"])}
                    at = r["dim"], r["shard"]
                qids = np.frombuffer(r["q_ids"], np.int64)
                kth = np.frombuffer(r["q_kth"], np.int64) if r["q_kth"] else np.full(len(qids), NONE + 1)
                s, w = search(tree, _array(r, "q_"), qids, kth, k)
                row, col = np.nonzero(s > NONE)
                yield pa.RecordBatch.from_pydict({"query_id": qids[row], "vec_id": w[row, col], "score": s[row, col]})

    return run


def usable(v: Column) -> Column:
    """True where a vector takes part."""
    inf = float("inf")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < inf))
    return F.coalesce((F.size(v) > 0) & fine, F.lit(False))


def _nearest(pivots: dict[int, np.ndarray]):
    """Of each vector the nearest pivot of its length; 0 where there is none."""
    half = {d: (p * p).sum(axis=1) / 2 for d, p in pivots.items()}

    def run(column: pa.Array) -> pa.Array:
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        out = np.zeros(len(column), np.int32)
        for d in np.unique(sizes):
            if d in pivots:
                at = np.flatnonzero(sizes == d)
                x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), d)
                for i in range(0, len(at), 4_096):
                    out[at[i : i + 4_096]] = (x[i : i + 4_096] @ pivots[d].T - half[d]).argmax(axis=1)
        return pa.array(out, pa.int32())

    return run


def _roots(t: pa.Table) -> pa.Table:
    """One page of shards' roots."""
    o = np.argsort(t["shard"].to_numpy(), kind="stable")
    centres = np.stack([np.frombuffer(c) for c in t["centre"].to_pylist()])[o]
    cols = {"dim": t["dim"][:1], "page": t["page"][:1], "shards": [t["shard"].to_numpy()[o].tobytes()]}
    return pa.table({**cols, "cs": [centres.tobytes()], "rs": [t["radius"].to_numpy()[o].tobytes()]})


def _bounds(first: int | None):
    """(dim, block, shard, bound) of each block with a page's shards: the first by bound, or all that may hold a result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = {n: b.column(j)[i].as_py() for j, n in enumerate(b.schema.names)}
                q = _array(r, "q_").astype(np.float64)
                shards, c = np.frombuffer(r["shards"], np.int64), np.frombuffer(r["cs"]).reshape(-1, r["dim"])
                bound = q @ c.T + np.sqrt((q * q).sum(axis=1))[:, None] * np.frombuffer(r["rs"])[None, :]
                bound += 1e-9 * (np.abs(bound) + 1) + 0.5
                best = bound.max(axis=0)
                if first:
                    at = np.argsort(-best, kind="stable")[:first]
                else:
                    at = np.flatnonzero((bound >= np.frombuffer(r["q_kth"], np.int64)[:, None]).any(axis=0))
                yield pa.RecordBatch.from_pydict(
                    {"dim": pa.array([r["dim"]] * len(at), pa.int32()), "block": pa.array([r["block"]] * len(at), pa.int64()), "shard": shards[at], "bound": best[at]}
                )

    return run


PAIR = "dim int, block bigint, shard bigint, bound double"


def _search(pairs: DataFrame, k: int) -> DataFrame:
    return pairs.mapInArrow(_search_rows(k), "query_id bigint, vec_id bigint, score bigint")


class TopK:
    """The search's tables over one input, all in the shared scratch folder."""

    def __init__(self, vectors: DataFrame, is_query: Column, scale: int, id_col: str, vec_col: str, shard_rows: int, block_rows: int) -> None:
        self.spark = vectors.sparkSession
        ship_package(self.spark)
        self.scratch = Scratch(self.spark, "topk")
        v = vectors.where(named(id_col).isNotNull() & usable(named(vec_col))).select(
            named(id_col).cast("long").alias("id"),
            F.transform(named(vec_col), lambda x: F.floor(x.cast("double") * scale)).alias("v"),
            F.coalesce(is_query, F.lit(False)).alias("q"),
        )
        v = v.groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q")).withColumn("dim", F.size("v"))
        v = self.scratch.keep(v, "vectors")
        wanted = min(PIVOTS, -(-2 * v.count() // shard_rows))
        # At most PIVOTS vectors come to the driver, those whose ids have the smallest hashes.
        drawn = [r["v"] for r in v.orderBy(F.xxhash64("id"), "id").select("v").limit(wanted).collect()]
        pivots = {d: np.unique(np.array([x for x in drawn if len(x) == d], np.float64), axis=0) for d in {len(x) for x in drawn}}
        v = v.withColumn("cell", F.arrow_udf(_nearest(pivots), "int")("v"))
        v = self.scratch.keep(v, "cells")
        cells = v.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("nq"))
        # A row for each pivot, or less.
        v = v.join(F.broadcast(cells), ["dim", "cell"])
        part = lambda n, most, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.greatest(F.lit(1), F.ceil(F.col(n) / most)))
        place = lambda p: (F.shiftleft(F.col("cell").cast("long"), 32) + p).cast("long")
        v = v.withColumn("shard", place(part("n", shard_rows, 1))).withColumn("block", place(part("nq", block_rows, 2)))
        self.shards = self.scratch.keep(
            v.groupBy("dim", "shard").applyInArrow(_shards, "dim int, shard bigint, nodes binary, centres binary, radii binary, " + BLOB), "shards"
        )
        self.queries = self.scratch.keep(v.where("q").select("dim", "block", "id"), "queries")
        blocks = self.scratch.keep(v.where("q").groupBy("dim", "block").applyInArrow(_blocks, "dim int, block bigint, " + BLOB), "blocks")
        self.blocks = blocks.select("dim", "block", *(F.col(c).alias(f"q_{c}") for c in ("n", "x", "kind", "ids")))
        # A tree's first node is its root.
        roots = self.shards.select("dim", "shard", F.substring("centres", F.lit(1), F.col("dim") * 8).alias("centre"), _first_double("radii").alias("radius"))
        roots = roots.withColumn("page", F.floor(F.row_number().over(W.partitionBy("dim").orderBy("shard")) / PAGE_ROWS).cast("int"))
        self.pages = self.scratch.keep(roots.groupBy("dim", "page").applyInArrow(_roots, "dim int, page int, shards binary, cs binary, rs binary"), "roots")

    def with_pages(self, blocks: DataFrame) -> DataFrame:
        """Each block beside each page of its vectors' length; SALTS tasks share what would be one key."""
        salted = blocks.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int"))
        copies = self.pages.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return salted.join(copies, ["dim", "salt"]).drop("salt")

    def first_pairs(self) -> DataFrame:
        """For each block the shards of the highest bounds."""
        met = self.with_pages(self.blocks.withColumn("q_kth", F.lit(None).cast("binary")))
        order = W.partitionBy("dim", "block").orderBy(F.desc("bound"), "shard")
        best = met.mapInArrow(_bounds(FIRST), PAIR).withColumn("at", F.row_number().over(order))
        return self.scratch.keep(best.where(F.col("at") <= FIRST).select("dim", "block", "shard"), "first-pairs")

    def other_pairs(self, done: DataFrame, kth: DataFrame) -> DataFrame:
        """The further shards that may hold a result of a block, by the k-th scores found so far."""
        met = self.with_pages(self.blocks.join(kth, ["dim", "block"]))
        pairs = met.mapInArrow(_bounds(None), PAIR).select("dim", "block", "shard")
        return self.scratch.keep(pairs.join(done, ["dim", "block", "shard"], "left_anti"), "pairs")

    def kth_scores(self, found: DataFrame, k: int) -> DataFrame:
        """(dim, block, q_kth): of each query the k-th score found, in the order of ids."""
        order = W.partitionBy("query_id").orderBy(F.desc("score"))
        kth = found.withColumn("at", F.row_number().over(order)).where(F.col("at") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
        held = self.queries.join(kth, "id", "left").select("dim", "block", "id", F.coalesce("kth", F.lit(NONE + 1)).alias("kth"))
        held = held.groupBy("dim", "block").applyInArrow(_kth_blob, "dim int, block bigint, q_kth binary")
        return self.scratch.keep(held, "kth")

    def searched(self, pairs: DataFrame, kth: DataFrame, k: int) -> DataFrame:
        return _search(pairs.join(self.blocks, ["dim", "block"]).join(kth, ["dim", "block"], "left").join(self.shards, ["dim", "shard"]), k)

    def results(self, k: int) -> DataFrame:
        some = self.first_pairs()
        none = self.blocks.select("dim", "block", F.lit(None).cast("binary").alias("q_kth")).limit(0)
        first = self.scratch.keep(self.searched(some, none, k), "first")
        kth = self.kth_scores(first, k)
        rest = self.other_pairs(some, kth)
        return _ranked(first.unionByName(self.searched(rest, kth, k)), k)


def _first_double(c: str) -> Column:
    """The first of the doubles in a binary."""
    return F.arrow_udf(lambda a: pa.array([np.frombuffer(x.as_py()[:8])[0] for x in a], pa.float64()), "double")(c)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = 20,
    scale: int = 64,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with is_query its k best other rows."""
    return TopK(vectors, is_query, scale, id_col, vec_col, shard_rows, block_rows).results(k)


def _kth_blob(t: pa.Table) -> pa.Table:
    o = np.argsort(t["id"].to_numpy(), kind="stable")
    blob = t["kth"].to_numpy().astype(np.int64)[o].tobytes()
    return pa.table({"dim": t["dim"][:1], "block": t["block"][:1], "q_kth": pa.array([blob], pa.binary())})


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
