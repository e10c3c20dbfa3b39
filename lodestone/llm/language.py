"""Language identification by nearest centroids.

Method: a text is the bag of its character n-grams (1 to 3, lower-cased, runs of other
characters as one space), hashed to DIM places and weighted by TF-IDF with unit norm. The
document frequencies cover all labelled rows. Per language a bounded sample of at most
train_rows distinct labelled texts, those with the smallest hashes, is clustered by spherical
k-means (k-means++ seeds, RESTARTS runs, clusters under LEAST_SHARE of the sample dissolved). A
text goes to the language of the centroid with the highest cosine, which is its score.

It is rejected if it has no letter or lies too far from the centroid: short texts reach lower
cosines than long ones, so each language has a limit for every length (doubling n-gram counts),
learnt from the sampled texts and from pieces of them. A limit is where texts of the other
languages end, but at least NEAR and at most FAR of the cosine that QUANTILE of the language's
own texts of that length fall below.

Defined results: null text and text without any letter is `und` with score 0; empty training
data makes every text `und`; rows whose label is null teach nothing; repeated rows teach the
frequencies once each, and the centroids once; ties between centroids go to the language that is
first by name; repeated rows each get a result; whole texts count whatever their length; extra
columns pass through, but for those whose name starts with _lid, which are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.llm.text import all_of, named, without_reserved
from lodestone.runtime import Scratch, release_memory, ship_package

DIM_BITS = 12
DIM = 1 << DIM_BITS
GRAMS = (1, 2, 3)
TRAIN_ROWS = 1_000
CLUSTERS = 3
STEP_CHARS = 500_000
UND = "und"
RESTARTS = 4
LEAST_SHARE = 0.05
QUANTILE, NEAR, FAR = 0.01, 0.6, 0.75
PIECES = tuple(1 << i for i in range(2, 13))  # characters of the pieces that limits are learnt from
BUCKETS = 32  # texts whose n-gram counts have so many binary digits share a limit
_MULT = np.uint64(0x9E3779B97F4A7C15)


def counts(texts: list[str]) -> np.ndarray:
    """Of each text how many of its n-grams fall to each place: texts x DIM."""
    out = np.zeros((len(texts), DIM), np.float32)
    todo: list[tuple[int, str]] = []
    size = 0
    for i, t in enumerate(texts):
        for at in range(0, len(t), STEP_CHARS):
            # A step sees the characters before it that its n-grams begin in.
            piece = t[max(0, at - max(GRAMS) + 1) : at + STEP_CHARS]
            todo.append((i, piece))
            size += len(piece)
            if size >= STEP_CHARS:
                _count(todo, out)
                todo, size = [], 0
    _count(todo, out)
    return out


def _count(pieces: list[tuple[int, str]], out: np.ndarray) -> None:
    if not pieces:
        return
    low = [p.lower() for _, p in pieces]
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(low)), [len(p) for p in low])
    # Letters stay; all else is one space. Whatever is not ASCII counts as a letter.
    code = np.where(((code >= 97) & (code <= 122)) | (code >= 170), code, np.uint64(32))
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32) | (row[1:] != row[:-1])
    code, row = code[keep], row[keep]
    got = np.zeros((len(low), DIM), np.float32)
    h = np.zeros(len(code), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h = (h[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :] + np.uint64(n)) if len(code) >= n else h[:0]
        if n in GRAMS and len(h):
            same = row[: len(h)] == row[n - 1 :]
            place = ((h * _MULT) >> np.uint64(64 - DIM_BITS)).astype(np.int64)
            flat = np.bincount((row[: len(h)] * DIM + place)[same], minlength=len(low) * DIM)
            got += flat.reshape(len(low), DIM)
    np.add.at(out, [i for i, _ in pieces], got)


def weigh(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(n) * idf[None, :]
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return (v / np.where(norm > 0, norm, 1)).astype(np.float32)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    return weigh(counts(texts), idf)


def bucket(n: np.ndarray) -> np.ndarray:
    """Binary digits of a text's number of n-grams."""
    return np.minimum(np.floor(np.log2(np.maximum(n.sum(axis=1), 1))).astype(np.int64), BUCKETS - 1)


def _unit(c: np.ndarray) -> np.ndarray:
    return c / np.maximum(np.sqrt((c * c).sum(axis=1, keepdims=True)), 1e-12)


def spread_clusters(v: np.ndarray, k: int, rounds: int = 25) -> list[tuple[np.ndarray, int]]:
    """Spherical k-means: (unit centroid, members). The best of RESTARTS runs from k-means++ seeds."""
    rng = np.random.default_rng(len(v))
    best: tuple[float, list] = (-np.inf, [])
    for _ in range(RESTARTS):
        c = v[[int(rng.integers(len(v)))]]
        while len(c) < min(k, len(v)):
            far = np.maximum(1 - (v @ c.T).max(axis=1), 0)
            if far.sum() <= 1e-6:
                break
            c = np.concatenate([c, v[[int(rng.choice(len(v), p=far / far.sum()))]]])
        own = None
        for _ in range(rounds):
            now = (v @ c.T).argmax(axis=1)
            if own is not None and (now == own).all():
                size = np.bincount(own, minlength=len(c))
                if len(c) == 1 or size.min() >= LEAST_SHARE * len(v):
                    break
                c = np.delete(c, size.argmin(), axis=0)  # too small: its members go to the others
                now = (v @ c.T).argmax(axis=1)
            own = now
            c = _unit(np.array([v[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))]))
        own = (v @ c.T).argmax(axis=1)
        total = float((v * c[own]).sum())
        if total > best[0]:
            best = total, [(c[j], int((own == j).sum())) for j in range(len(c)) if (own == j).any()]
    return best[1]


def _slices(column: pa.Array, chars: int = 4 * STEP_CHARS) -> Iterator[list[str]]:
    part, size = [], 0
    for t in column:
        t = t.as_py() or ""
        part.append(t)
        size += len(t) + 2_000
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(DIM, np.int64)
    for b in batches:
        for part in _slices(b.column(0)):
            total += (counts(part) > 0).sum(axis=0)
    at = np.flatnonzero(total)
    release_memory()
    yield pa.RecordBatch.from_pydict({"place": at, "df": total[at]})


class Model:
    """idf, the centroids (language, centroid, members) and a limit for each language and length."""

    def __init__(self, idf: np.ndarray, centroids: list[tuple[str, np.ndarray, int]], limits: dict[str, np.ndarray] | None = None) -> None:
        centroids = sorted(centroids, key=lambda c: (c[0], -c[2]))
        self.idf = idf
        self.names = [c[0] for c in centroids]
        self.sizes = [c[2] for c in centroids]
        self.matrix = np.array([c[1] for c in centroids], np.float32).reshape(len(centroids), DIM)
        none = np.zeros(BUCKETS)
        self.limits = np.array([(limits or {}).get(n, none) for n in self.names]).reshape(len(centroids), BUCKETS)

    def cosines(self, n: np.ndarray) -> np.ndarray:
        return np.clip(weigh(n, self.idf) @ self.matrix.T, 0, 1)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of each text."""
        letters = np.array([any(map(str.isalpha, t)) for t in texts], bool)
        if not self.names:
            return [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        n = counts(texts)
        s = self.cosines(n)
        at = s.argmax(axis=1)
        best = s[np.arange(len(texts)), at] * letters
        return [self.names[j] if a else UND for j, a in zip(at, letters, strict=True)], best, ~letters | (best < self.limits[at, bucket(n)])


def pieces_of(text: str) -> list[str]:
    """The text and pieces from its middle, that begin with a word if they can."""
    out = [text]
    for size in PIECES:
        if len(text) >= 2 * size:
            at = (len(text) - size) // 2
            space = text.find(" ", at, at + size)
            at = at if space < 0 else space + 1
            out.append(text[at : at + size])
    return out


def limit_at(own: np.ndarray, other: np.ndarray) -> float:
    """A language's limit at one length, from cosines of its own texts and of other languages' texts."""
    low = np.sort(own)[int(QUANTILE * len(own))]
    end = np.quantile(other, 1 - QUANTILE) if len(other) else 0.0
    return float(min(FAR * low, max(NEAR * low, end)))


def limit_curve(limits: dict[int, float]) -> np.ndarray:
    """A language's limit for each length, from those of the lengths seen."""
    if not limits:
        return np.zeros(BUCKETS)
    known = sorted(limits)
    # Shorter texts than any seen have no limit; longer ones that of the longest.
    return np.interp(np.arange(BUCKETS), known, [limits[k] for k in known], left=0.0)


def sample(rows: DataFrame, train_rows: int, scratch: Scratch) -> DataFrame:
    """rows(lang, text): of each language the train_rows distinct texts with the smallest hashes, or all if they are fewer.

    Hashes are counted by ranges, once a text however often it repeats; only the ranges that hold the
    smallest ones are ordered.
    """
    hashed = rows.withColumn("h", F.xxhash64("text"))
    distinct = scratch.keep(hashed.select("lang", "h").distinct().withColumn("at", F.xxhash64("h")), "hashes")
    distinct = distinct.withColumn("range", F.shiftright("at", 48))
    # At most 65,536 ranges a language.
    sofar = F.sum("n").over(W.partitionBy("lang").orderBy("range"))
    ranges = distinct.groupBy("lang", "range").agg(F.count(F.lit(1)).alias("n")).withColumn("sofar", sofar)
    cut = ranges.groupBy("lang").agg(F.coalesce(F.min(F.when(F.col("sofar") >= train_rows, F.col("range"))), F.max("range")).alias("cut"))
    near = distinct.join(F.broadcast(cut), "lang").where(F.col("range") <= F.col("cut"))
    order = W.partitionBy("lang").orderBy("at", "h")
    first = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= train_rows).select("lang", "h")
    # languages x train_rows hashes; a text's copies meet in a partial aggregate.
    return hashed.join(F.broadcast(first), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))


def train(
    labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS, clusters: int = CLUSTERS
) -> Model:
    """A model from labelled texts; what comes to the driver is bounded by languages x clusters x DIM."""
    spark = labelled.sparkSession
    ship_package(spark)
    rows = labelled.where(named(lang_col).isNotNull() & named(text_col).isNotNull()).select(
        named(text_col).alias("text"), named(lang_col).alias("lang")
    )
    per_lang = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    df = rows.select("text").mapInArrow(_frequencies, "place long, df long").groupBy("place").agg(F.sum("df").alias("df")).collect()
    total = sum(per_lang.values())
    idf = np.full(DIM, math.log(1 + total) + 1, np.float32)
    for r in df:
        idf[r["place"]] = math.log((1 + total) / (1 + r["df"])) + 1
    if not per_lang:
        return Model(idf, [])

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for part in _slices(b["text"], STEP_CHARS):
                v = vectors(part, idf)
                yield pa.RecordBatch.from_arrays([b["lang"].slice(at, len(part)), pa.array([x.tobytes() for x in v], pa.binary())], names=["lang", "v"])
                at += len(part)
        release_memory()

    def cluster(t: pa.Table) -> pa.Table:
        v = np.frombuffer(b"".join(sorted(t["v"].to_pylist())), np.float32).reshape(-1, DIM)
        got = spread_clusters(v, clusters)
        return pa.table({"lang": [t["lang"][0].as_py()] * len(got), "c": [c.astype(np.float32).tobytes() for c, _ in got], "m": [m for _, m in got]})

    scratch = Scratch(spark, "language")
    some = scratch.keep(sample(rows, train_rows, scratch).select("lang", "text"), "sample")
    found = some.mapInArrow(vectorise, "lang string, v binary").groupBy("lang").applyInArrow(cluster, "lang string, c binary, m long").collect()
    centroids = [(r["lang"], np.frombuffer(r["c"], np.float32), r["m"]) for r in found]
    model = Model(idf, centroids)
    names = sorted(set(model.names))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each piece and language the piece's length, its best cosine with that language, whether it is its own."""
        for b in batches:
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                n = counts([p for p in pieces_of(text) if any(map(str.isalpha, p))])
                if len(n):
                    s, size = model.cosines(n), bucket(n)
                    for k in names:
                        best = s[:, [i for i, x in enumerate(model.names) if x == k]].max(axis=1).astype(np.float64)
                        yield pa.RecordBatch.from_pydict({"lang": [k] * len(n), "size": pa.array(size, pa.int64()), "cos": best, "own": [lang == k] * len(n)})

    def learn(t: pa.Table) -> pa.Table:
        own, cos = t["own"].to_numpy(zero_copy_only=False), t["cos"].to_numpy()
        some_own = own.any()
        limits = [limit_at(cos[own], cos[~own])] if some_own else []
        return pa.table({"lang": t["lang"][: len(limits)], "size": t["size"][: len(limits)], "least": pa.array(limits, pa.float64())})

    # A group holds pieces of the sample alone; to the driver come at most BUCKETS limits a language.
    seen = some.mapInArrow(near, "lang string, size long, cos double, own boolean")
    learnt = seen.groupBy("lang", "size").applyInArrow(learn, "lang string, size long, least double").collect()
    scratch.drop("sample", "hashes")
    limits = {k: limit_curve({r["size"]: r["least"] for r in learnt if r["lang"] == k}) for k in names}
    return Model(idf, centroids, limits)


def predict(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """docs with _lid_lang, _lid_score, _lid_rejected."""
    ship_package(docs.sparkSession)
    docs = without_reserved(docs, "_lid")
    kind = "struct<lang: string, score: double, rejected: boolean>"

    @F.arrow_udf(kind)
    def classify(column: pa.Array) -> pa.Array:
        langs, scores, rejected = [], [], []
        for part in _slices(column):
            a, b, c = model.predict(part)
            langs += a
            scores.append(b)
            rejected.append(c)
        release_memory()
        join = lambda x, t: np.concatenate([*x, np.zeros(0, t)]).astype(t)
        return pa.StructArray.from_arrays(
            [pa.array(langs, pa.string()), pa.array(join(scores, np.float64)), pa.array(join(rejected, bool))], names=["lang", "score", "rejected"]
        )

    # As it is, a filter on the result would run the classifier twice.
    classify = classify.asNondeterministic()
    out = docs.withColumn("_lid", classify(named(text_col)))
    return out.select(
        *all_of(docs), F.col("_lid.lang").alias("_lid_lang"), F.col("_lid.score").alias("_lid_score"), F.col("_lid.rejected").alias("_lid_rejected")
    )


def held_out(id_col: Column) -> Column:
    """True for the documents that are never trained on."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))
