"""N-gram Jaccard join by grouped prefixes.

Method: a document's set of word shingles is hashed to 64 bits. Equal sets become one
representative. All tokens are ordered by (document frequency, hash), rare first; two sets
whose Jaccard is at least t share a token among their first |x| - ceil(t |x|) + 1. Sets with
the same prefix and size are collapsed into one group, groups that share a prefix token are
paired under length and position filters, and pairs are expanded to members and verified on
their whole sets.

Frequencies are counted over all representatives. To keep that count small only the tokens of
large sets in the lowest part of the hash range are counted, the share that a prefix takes and REGION deviations
of a set of SMALL tokens more; their order has the counted
tokens of at most COMMON documents first, by frequency, then the other uncounted ones, then the
counted common ones, which no prefix reaches. Sets with too few rare counted tokens for their
prefix, mostly near copies, need the order of uncounted tokens: it goes by their frequency among
those sets, which are read once more for it. That is a fixed order of all tokens, so no pair is
missed. Sets of at most SMALL tokens are ordered by the frequencies of all their tokens. A
pair within the threshold always meets in one of the two orders, which overlap in size. Below
FULL_BELOW percent, where a prefix may outgrow what is rare or uncounted, all sets are ordered
like small ones.

A token that very many documents share never emits all their pairs. First each token's
documents are paired with one hub, the one with the fewest rare tokens (the likely original
of near copies), and verified; connected components follow from the verified links. Then only
pairs whose ends lie in different components are still candidates: within a token, members
outside its largest component against all others. Both rounds together miss no link between
components, so components are exact although links inside one are not all listed.

Words are hashed to 128 bits and shingles to 64. Two different sets have equal digests with a
probability under 2^-64, under 2^-128 up to DOUBLE shingles; two shingles of a verified pair of
sets of n count as shared wrongly with a probability under n^2 / 2^64. Sets too small for any
link but equality make no pairs.

Defined results: words are runs without ASCII white space after lower-casing A-Z; a text of
fewer words than n has one shingle, the whole sequence; null, empty or blank texts have an
empty set and link with nothing; repeated rows and ids are kept, equal sets are linked; a
null id is never the smallest unless its component has no other; an empty table gives no
rows; extra columns pass through, but for those whose name starts with _jac, which are dropped.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import connected_components
from lodestone.llm.text import all_of, named, without_reserved
from lodestone.runtime import BLOOM_JOINS, Scratch, release_memory, settings, ship_package

SHINGLE = 3
PERCENT = 90
REGION = 2.83
SMALL = 128
#: Below this many percent prefixes take so much of a set that all sets are ordered by the frequencies of all their tokens.
FULL_BELOW = 70
COMMON = 8
SETS_A_FILE = 40_000
HELD = 512  # longer prefixes may make a pair at several tokens; it is still verified once
STEP_BYTES = 500_000
#: Batches of texts to the workers are kept small, as every text's tokens stand beside it.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
DOUBLE = 64  # sets of at most so many shingles are hashed twice for their digest
CACHED = 200_000  # words whose hash a worker holds
BASE = 0x9E3779B97F4A7C15
_U = np.uint64
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class _Hashes(dict):
    """The 128-bit hash of a word."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHED:
            self.clear()
        h = xxhash.xxh3_128_digest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_hashes = _Hashes()


def _slices(text: bytes) -> Iterator[bytes]:
    """text in slices of about STEP_BYTES that end after white space."""
    at = 0
    while at < len(text):
        hit = _SPACE.search(text, at + STEP_BYTES) if at + STEP_BYTES < len(text) else None
        end = hit.end() if hit else len(text)
        yield text[at:end]
        at = end


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(words of each text, words x 2 hashes). A-Z count as a-z; bytes know ASCII white space and letters only."""
    counts, found = [], []
    for t in texts:
        n = 0
        for piece in [t] if len(t) <= STEP_BYTES else _slices(t):
            words = piece.lower().split()
            found.append(b"".join(map(_hashes.__getitem__, words)))
            n += len(words)
        counts.append(n)
    return np.array(counts, np.int64), np.frombuffer(b"".join(found), np.uint64).reshape(-1, 2)


def _chained(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n neighbouring words, by all their 128 bits."""
    m = max(0, len(h) - n + 1)
    s = np.zeros(m, np.uint64)
    for i in range(n):
        s = _mix(_mix(s * _U(BASE) + h[i : i + m, 0]) + h[i : i + m, 1])
    return s


def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> list[tuple[np.ndarray, bytes]]:
    """Of each text the sorted distinct shingle hashes, and further bytes for a small set's digest."""
    words, h = word_hashes(texts)
    first = np.concatenate([[0], np.cumsum(words)])
    s = _chained(h, n)
    out = []
    for a, w in zip(first[:-1], words, strict=True):
        if w >= n:
            all_ = s[a : a + w - n + 1]
            one = np.unique(all_)
        elif w:
            # Short texts are one shingle, told from longer ones by their number of words.
            all_ = one = _mix(_chained(h[a : a + w], int(w)) + _U(w))
        else:
            out.append((np.zeros(0, np.uint64), b""))
            continue
        more = b""
        if len(one) <= DOUBLE:
            at = np.unique(all_, return_index=True)[1]
            other = _chained(h[a : a + w, ::-1] ^ _U(BASE), n if w >= n else int(w))
            more = np.sort(other[at]).tobytes()
        out.append((one, more))
    return out


def _steps(column: pa.Array) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in column:
        b = t.as_py() or b""
        part.append(b)
        size += len(b)
        if size >= STEP_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """n - ceil(percent/100 n) + 1."""
    return n - -(-percent * n // 100) + 1


def least_size(percent: int) -> int:
    """Smaller sets link with equal ones only: one shingle more or less is already too much."""
    n = 1
    while 100 * n < percent * (n + 1):
        n += 1
    return n


def region_limit(percent: int) -> np.uint64:
    """Hashes below this are counted."""
    p = (100 - percent) / 100
    return _U(min(2**64 - 1, int((p + REGION * math.sqrt(p * (1 - p) / SMALL)) * 2**64)))


def shown_tokens(s: np.ndarray, percent: int) -> tuple[np.ndarray | None, np.ndarray | None]:
    """(all tokens in the order of small sets, counted tokens in that of large sets).

    None where the set is not part of the order. Tokens of the two orders are hashed apart.
    """
    n = len(s)
    if percent < FULL_BELOW:
        return (np.sort(_mix(s ^ _U(BASE))) if n else None), None
    small = np.sort(_mix(s ^ _U(BASE))) if n and n * percent <= SMALL * 100 + percent else None
    return small, s[: int(np.searchsorted(s, region_limit(percent)))] if n >= SMALL else None


def _digest(s: np.ndarray, more: bytes) -> bytes:
    return hashlib.blake2b(s.tobytes() + more, digest_size=16).digest()


PROFILE = "struct<n: bigint, dig: binary, small: array<bigint>, large: array<bigint>>"


def _profiles(n_words: int, percent: int):
    """Of each text its set's size and digest, and its tokens in both orders; null tokens and digest without words."""

    def run(column: pa.Array) -> pa.Array:
        n, dig, toks = [], [], ([], [])
        least = least_size(percent)
        for part in _steps(pc.cast(column, pa.binary())):
            for s, more in shingle_sets(part, n_words):
                n.append(len(s))
                dig.append(_digest(s, more) if len(s) else None)
                for to, t in zip(toks, shown_tokens(s, percent) if len(s) >= least else (None, None), strict=True):
                    to.append(None if t is None else t.view(np.int64))
        release_memory()
        kind = pa.list_(pa.int64())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(dig, pa.binary()), *(pa.array(t, kind) for t in toks)], names=["n", "dig", "small", "large"])

    return run


def _set_rows(n_words: int, percent: int, uncounted: bool = False):
    """(rid, text) -> (rid, s): the whole set as bytes, or its uncounted tokens as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for part in _steps(pc.cast(b["text"], pa.binary())):
                sets = [s for s, _ in shingle_sets(part, n_words)]
                if uncounted:
                    kind, sets = pa.list_(pa.int64()), [s[int(np.searchsorted(s, region_limit(percent))) :].view(np.int64) for s in sets]
                else:
                    kind, sets = pa.binary(), [s.tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([b["rid"].slice(at, len(part)), pa.array(sets, kind)], names=["rid", "s"])
                at += len(part)
        release_memory()

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch["sa"], batch["sb"], strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                ok.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return run


class JaccardJoin:
    """The join's steps over one input; every table goes to the shared scratch folder."""

    def __init__(self, docs: DataFrame, text_col: str, n_words: int, percent: int) -> None:
        self.spark = docs.sparkSession
        ship_package(self.spark)
        self.docs, self.text_col, self.n_words, self.percent = docs, text_col, n_words, percent
        self.scratch = Scratch(self.spark, "jaccard")
        self.files = 8  # of the tables that have a few rows per set

    def representatives(self) -> tuple[DataFrame, DataFrame]:
        """docs with _jac(n, dig), shingled once; one row for each distinct set: rid, dig, n, small, large."""
        f = F.arrow_udf(_profiles(self.n_words, self.percent), PROFILE).asNondeterministic()
        profiled = self.docs.withColumn("_jac", f(F.coalesce(named(self.text_col), F.lit(""))))
        rows = self.scratch.keep(profiled, "rows")
        one = rows.where("_jac.dig IS NOT NULL").select("_jac.*").groupBy("dig").agg(*(F.first(c).alias(c) for c in ("n", "small", "large")))
        reps = self.scratch.keep(one.withColumn("rid", F.monotonically_increasing_id()), "reps")
        self.files = 4 + reps.count() // SETS_A_FILE
        return rows, reps

    def ranked(self, shown: DataFrame, common=None) -> DataFrame:
        """shown(eid, tok) -> (eid, t, common): tokens of several entries, by frequency; common ones are only counted."""
        often = shown.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
        no = F.lit(False) if common is None else common
        g = shown.join(often, "tok").groupBy("eid").agg(
            F.array_sort(F.collect_list(F.when(~no, F.struct("df", "tok")))).alias("t"), F.count_if(no).cast("int").alias("common")
        )
        return g.withColumn("t", F.transform("t", lambda x: x["tok"]))

    def postings(self, reps: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Prefix tokens that more than one set shows: (tok, rid, gid, n, ord, pos, rare); (dig, rid).

        An entry is a set in one order: eid is 2 rid, plus 1 in the order of large sets.
        rare is the share of its ranked tokens that it has alone.
        """
        none = F.array().cast("array<bigint>")
        small = reps.where("small IS NOT NULL").select((F.col("rid") * 2).alias("eid"), "rid", "n", F.col("small").alias("toks"))
        large = reps.where("large IS NOT NULL").select((F.col("rid") * 2 + 1).alias("eid"), "rid", "n", F.col("large").alias("toks"))
        entries = small.unionByName(large)
        shown = entries.select("eid", F.explode("toks").alias("tok"))
        mine = self.ranked(shown, (F.col("eid") % 2 == 1) & (F.col("df") > COMMON))
        length = (F.col("n") - F.ceil(F.col("n") * self.percent / 100) + 1).cast("int")
        per = entries.select("eid", "rid", "n", F.size("toks").alias("low")).join(mine, "eid", "left")
        per = per.withColumn("t", F.coalesce("t", none)).withColumn("len", length)
        per = per.withColumn("counted", F.col("low") - F.coalesce("common", F.lit(0))).withColumn("alone", F.col("counted") - F.size("t"))
        # Places alone .. counted - 1 are those of t.
        per = self.scratch.keep(per.where("alone < len").drop("common"), "ranked", self.files)
        names = self.scratch.keep(reps.select("dig", "rid"), "names", self.files)
        self.scratch.drop("reps")
        self.scratch.release()
        late = per.where("counted < len")
        rest = self.read_again(late.select("rid").distinct(), names, rows, uncounted=True)
        self.scratch.release()
        rest = self.scratch.keep(rest.select((F.col("rid") * 2 + 1).alias("eid"), F.col("s").alias("toks")), "rest", self.files)
        more = self.ranked(rest.select("eid", F.explode("toks").alias("tok"))).select("eid", F.col("t").alias("more"))
        more = rest.select("eid", F.size("toks").alias("all")).join(more, "eid", "left").select("eid", F.coalesce("more", none).alias("more"), (F.col("all") - F.size(F.coalesce("more", none))).alias("single"))
        per = per.join(more, "eid", "left").withColumn("more", F.coalesce("more", none)).withColumn("single", F.coalesce("single", F.lit(0)))
        # Then come the uncounted tokens that it has alone, then more.
        cut = lambda c, k: F.slice(c, F.lit(1), F.greatest(F.lit(0), k))
        t, m = cut("t", F.col("len") - F.col("alone")), cut("more", F.col("len") - F.col("counted") - F.col("single"))
        alone = F.when(F.col("counted") < F.col("len"), F.col("alone") + F.col("single")).otherwise(F.col("alone"))
        gid = F.when(alone == 0, F.xxhash64("n", F.concat(t, m))).otherwise(F.xxhash64("rid", F.lit("alone")))
        first = F.transform(t, lambda x, i: F.struct(x.alias("tok"), (F.col("alone") + i).cast("long").alias("pos")))
        then = F.transform(m, lambda x, i: F.struct(x.alias("tok"), (F.col("counted") + F.col("single") + i).cast("long").alias("pos")))
        at = per.select("rid", "n", gid.alias("gid"), (F.col("eid") % 2).alias("ord"), (alone / F.col("n")).alias("rare"), F.explode(F.concat(first, then)).alias("x"))
        at = self.scratch.keep(at.select("x.tok", "rid", "gid", "n", "ord", "x.pos", "rare"), "prefixes", self.files)
        met = at.groupBy("tok").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("tok")
        post = self.scratch.keep(at.join(met, "tok"), "postings", self.files)
        self.scratch.drop("prefixes", "ranked", "rest", "again-rest")
        self.scratch.release()
        return post, names

    def read_again(self, rids: DataFrame, reps: DataFrame, rows: DataFrame, uncounted: bool = False) -> DataFrame:
        """(rid, s) of some representatives, from their texts; only those texts are shuffled."""
        name = "again" + "-rest" * uncounted
        wanted = self.scratch.keep(reps.select("dig", "rid").join(rids, "rid"), f"{name}-rids", self.files)
        texts = rows.select(F.col("_jac.dig").alias("dig"), named(self.text_col).alias("text"))
        kind = "rid bigint, s array<bigint>" if uncounted else "rid bigint, s binary"
        # The planner makes a Bloom filter only of a side that has a filter of its own.
        with settings(self.spark, BLOOM_JOINS):
            texts = texts.join(wanted.where("rid >= 0"), "dig").groupBy("rid").agg(F.first("text").alias("text"))
            return self.scratch.keep(texts.mapInArrow(_set_rows(self.n_words, self.percent, uncounted), kind), name)

    def passes(self, a: str, b: str):
        """Length and position filters of a pair of posting rows."""
        na, nb, pa_, pb = (F.col(f"{x}.{c}") for c in ("n", "pos") for x in (a, b))
        p = self.percent
        least = F.least(na - pa_, nb - pb)  # what the two can share from this token on
        return (F.least(na, nb) * 100 >= F.greatest(na, nb) * p) & (least * (100 + p) >= (na + nb) * p)

    def verified(self, pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        """pairs(a, b) with ok: whether their whole sets are within the threshold."""
        half = pairs.join(sets.select(F.col("rid").alias("a"), F.col("s").alias("sa")), "a")
        full = half.join(sets.select(F.col("rid").alias("b"), F.col("s").alias("sb")), "b")
        checked = full.select("a", "b", "sa", "sb").mapInArrow(_verify(self.percent), "a bigint, b bigint, ok boolean")
        return self.scratch.keep(checked, name, self.files)

    def components(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(node, comp) of all linked representatives, comp being one of their rids; (dig, rid); docs with _jac."""
        rows, reps = self.representatives()
        self.scratch.release()
        post, names = self.postings(reps, rows)
        sets = self.read_again(post.select("rid").distinct(), names, rows)
        # Round 1: the members of a group with its first, and each token's groups with its hub.
        heads = post.groupBy("gid").agg(F.min("rid").alias("a"))
        inside = post.select("gid", "rid").distinct().join(heads, "gid").where("rid <> a").select("a", F.col("rid").alias("b"))
        hubs = post.groupBy("tok").agg(F.min_by(F.struct("rid", "n", "pos"), F.struct("rare", "rid")).alias("h"))
        near = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * self.percent
        stars = post.alias("x").join(hubs.select("tok", "h.*").alias("y"), "tok").where((F.col("x.rid") != F.col("y.rid")) & near)
        stars = stars.select(F.least("x.rid", "y.rid").alias("a"), F.greatest("x.rid", "y.rid").alias("b"))
        inside = inside.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        seen = self.verified(inside.unionByName(stars).distinct(), sets, "pairs1")
        one = seen.where("ok").drop("ok")
        self.scratch.release()
        comp = connected_components(one, self.scratch, "cc1")
        # Round 2: what the first left in different components, by group and component.
        unit = post.join(comp.withColumnRenamed("node", "rid"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
        unit = self.scratch.keep(unit.drop("rare"), "units", self.files)
        most = unit.groupBy("tok", "comp").agg(F.count(F.lit(1)).alias("c"))
        most = most.groupBy("tok").agg(F.max(F.struct("c", "comp"))["comp"].alias("main"), F.count(F.lit(1)).alias("k"))
        groups = unit.join(most.where("k > 1"), "tok").groupBy("tok", "gid", "comp", "n", "ord", "pos", "main").agg(F.min("rid").alias("any"))
        # A pair is made at the first token that both prefixes share, by what each holds before it.
        held = unit.groupBy("gid").agg(F.array_sort(F.collect_set(F.struct("ord", "pos", "tok"))).alias("held"))
        held = held.where(F.size("held") <= HELD)
        groups = groups.join(held, "gid", "left")
        before = F.filter("held", lambda x: (x["ord"] < F.col("ord")) | ((x["ord"] == F.col("ord")) & (x["pos"] < F.col("pos"))))
        groups = groups.withColumn("before", F.coalesce(F.transform(before, lambda x: x["tok"]), F.array().cast("array<bigint>"))).drop("held")
        few = groups.where("comp <> main")
        apart = (F.col("x.comp") != F.col("y.comp")) & self.passes("x", "y") & ~F.arrays_overlap("x.before", "y.before")
        pairs = few.alias("x").join(groups.alias("y"), "tok").where(apart)
        pairs = pairs.select(*(F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "xy" for c in ("gid", "comp"))).distinct()
        members = unit.select("gid", "comp", "rid").distinct()
        pairs = pairs.join(members.select(*(F.col(c).alias(f"{c}_x") for c in members.columns)), ["gid_x", "comp_x"])
        pairs = pairs.join(members.select(*(F.col(c).alias(f"{c}_y") for c in members.columns)), ["gid_y", "comp_y"])
        pairs = pairs.select(F.least("rid_x", "rid_y").alias("a"), F.greatest("rid_x", "rid_y").alias("b")).distinct()
        pairs = pairs.join(seen.drop("ok"), ["a", "b"], "left_anti")
        two = self.verified(pairs, sets, "pairs2").where("ok").drop("ok")
        comp = connected_components(one.unionByName(two), self.scratch, "cc2")
        self.scratch.drop("postings", "units", "again", "pairs1", "pairs2")
        return comp, names, rows


def jaccard_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_words: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """docs with _jac_n (size of the set), _jac_component (smallest id reachable by links) and _jac_comp.

    _jac_comp names the component by its sets and not by ids, which may be null or repeated; it
    is null for an empty set.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must lie between 1 and 100")
    docs = without_reserved(docs, "_jac")
    with settings(docs.sparkSession, BATCHES):
        rows, ids = _components(docs, id_col, text_col, n_words, percent)
    out = rows.join(ids, "_jac_dig", "left")
    return out.withColumn("_jac_component", F.coalesce("_jac_least", named(id_col))).select(*all_of(docs), "_jac_n", "_jac_component", "_jac_comp")


def _components(docs: DataFrame, id_col: str, text_col: str, n_words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """docs with _jac_n and _jac_dig; the smallest id reachable from each digest and its component's key."""
    j = JaccardJoin(docs, text_col, n_words, percent)
    comp, names, rows = j.components()
    known = names.join(comp.withColumnRenamed("node", "rid"), "rid", "left").select(F.col("dig").alias("_jac_dig"), F.coalesce("comp", "rid").alias("_jac_comp"))
    known = j.scratch.keep(known, "named", j.files)
    rows = rows.select(*all_of(docs), F.col("_jac.n").alias("_jac_n"), F.col("_jac.dig").alias("_jac_dig"))
    least = rows.select(named(id_col).alias("id"), "_jac_dig").join(known, "_jac_dig").groupBy("_jac_comp").agg(F.min("id").alias("_jac_least"))
    ids = j.scratch.keep(known.join(least, "_jac_comp").select("_jac_dig", "_jac_least", "_jac_comp"), "least", j.files)
    j.scratch.drop("named", "names")
    return rows, ids
