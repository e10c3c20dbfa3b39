"""Byte-level BPE encoding and decoding by overlapping chunks.

Method: every text is dealt into chunks of chunk_chars characters that reach overlap characters
into the next one. Chunks are pre-tokenised each by itself. Where two neighbours' pre-token
boundaries coincide inside their overlap they have resynchronised: from there on both would go
on alike, so the text is cut there. The pieces between cuts are encoded and their ids joined in
order; decoding joins the ids' raw bytes.

A seam is taken only if its left chunk is anchored, i.e. its boundaries go on from a true one:
the text's start or a cut. A boundary counts only GUARD characters before its chunk's end or
earlier and before the chunk's last match, as the pattern may look ahead that far, and a cut
only after a character that is no white space (the pattern looks at what follows white space).
Where an overlap has no such place, e.g. in one endless word, the seam is dropped and the chunk
is pre-tokenised again from the last true boundary. So the ids are always those of the whole
text, for any pattern that looks behind nothing and at most GUARD characters, or white space, ahead.

A text's chunks are handled where the text is read, without a shuffle. A text longer than
part_chars is dealt into parts of that size, by the same rule, which many tasks handle; after
the first seam between parts that does not resynchronise the rest of that text is one part.
Such long texts are handled once per distinct text, so copies of them are no hot group; they
are joined back by their SHA-256. An Arrow batch's bytes are bounded by Spark.

Defined results: null counts as empty, which has no ids; repeated rows each get a result; an
empty table gives no rows; extra columns pass through unread, but for those that have a
result's name (n_tokens, n_pieces, ids_sha256, decoded_sha256, ids), which the result replaces,
and those whose name starts with _bpe_, which are dropped.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text import named, without_reserved
from lodestone.runtime import release_memory, ship_package

CHUNK_CHARS = 1_024
OVERLAP = 128
PART_CHARS = 262_144
GUARD = 16
STEP_BYTES = 1_000_000
_loaded: dict[str, tuple] = {}


def _load(codec: Codec) -> tuple:
    """(encoder, bytes of each id, decimal of each id, pattern), kept by the worker process."""
    if codec.key not in _loaded:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in codec.data.splitlines() if line)}
        raw = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            raw[v] = k
        enc = tiktoken.Encoding("ranks", pat_str=codec.pattern, mergeable_ranks=ranks, special_tokens={})
        _loaded[codec.key] = enc, raw, [str(i).encode() for i in range(len(raw))], regex.compile(codec.pattern)
    return _loaded[codec.key]


class Codec:
    """Encodes and decodes by a rank file; ships the file's bytes (about 1 MB) to the workers."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        with open(ranks_path, "rb") as f:
            self.data = f.read()
        self.pattern = pattern
        self.key = hashlib.sha256(self.data + pattern.encode()).hexdigest()

    def encode(self, text: str) -> list[int]:
        return _load(self)[0].encode_ordinary(text)

    def decode(self, ids) -> bytes:
        return b"".join(map(_load(self)[1].__getitem__, ids))

    def joined(self, ids) -> bytes:
        return b",".join(map(_load(self)[2].__getitem__, ids))


def boundaries(pattern: regex.Pattern, text: str, start: int, end: int) -> list[int]:
    """Ends of the pre-tokens of text[start:end], as places in text, that do not hang on where it is cut off."""
    ends = [m.end() for m in pattern.finditer(text, start, end)]
    if end >= len(text):
        return ends
    if ends:
        ends.pop()
    while ends and ends[-1] > end - GUARD:
        ends.pop()
    return ends


def cuts(pattern: regex.Pattern, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP) -> list[int]:
    """True pre-token boundaries at which neighbouring chunks of text resynchronise."""
    out: list[int] = []
    if len(text) <= chunk:
        return out
    true = boundaries(pattern, text, 0, chunk + overlap)  # of the chunk before the seam
    last, seam, reach = 0, chunk, chunk
    while seam < len(text):
        own = boundaries(pattern, text, seam, seam + chunk + overlap)
        known = set(true[bisect_right(true, seam) :])
        at = next((i for i, e in enumerate(own) if e in known and not text[e - 1].isspace()), None) if known else None
        if at is not None and own[at] < len(text):
            out.append(own[at])
            true, last, reach = own[at:], own[at], chunk
            seam += chunk
            continue
        # Dropped: on from the last true boundary, each time twice as far.
        last = max(last, true[-1]) if true else last
        end = seam + reach + overlap
        true = boundaries(pattern, text, last, end)
        seam, reach = max(seam + chunk, (end - overlap) // chunk * chunk), 2 * reach
    return out


def _seam_marks(pattern: str, part: int, overlap: int):
    """Of each part the places, from the text's start, that may become cuts: near its start and near its end."""
    compiled = regex.compile(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads, tails = [], []
            for no, last, t in zip(b["no"].to_pylist(), b["last"].to_pylist(), b["piece"].to_pylist(), strict=True):
                at = no * part
                # A part that does not end the text is followed by something.
                ends = boundaries(compiled, t if last else t + "\0", 0, len(t))
                ok = [e for e in ends if not t[e - 1].isspace() and not (last and e == len(t))]
                heads.append([at + e for e in ok if e < overlap])
                tails.append([at + e for e in ok if e >= part])
            yield pa.RecordBatch.from_arrays(
                [b["key"], b["no"], pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))],
                names=["key", "no", "heads", "tails"],
            )

    return run


def _pieces(codec: Codec, text: str, chunk: int, overlap: int) -> tuple[list[int], int]:
    """The ids of text, encoded piece by piece, and how many pieces."""
    at = [0, *cuts(_load(codec)[3], text, chunk, overlap), len(text)]
    if len(at) == 2:
        return codec.encode(text), int(text != "")
    ids: list[int] = []
    for a, b in zip(at, at[1:], strict=False):
        ids += codec.encode(text[a:b])
    return ids, len(at) - 1


def _results(codec: Codec, text: str, chunk: int, overlap: int) -> tuple[int, int, bytes, bytes]:
    ids, pieces = _pieces(codec, text, chunk, overlap)
    return len(ids), pieces, codec.joined(ids), codec.decode(ids)


def _encode_pieces(codec: Codec, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_results(codec, t, chunk, overlap) for t in b["piece"].to_pylist()]
            cols = [pa.array([x[i] for x in out], k) for i, k in enumerate([pa.int64(), pa.int64(), pa.binary(), pa.binary()])]
            yield pa.RecordBatch.from_arrays([b["key"], b["start"], *cols], names=["key", "start", "n", "pieces", "ids", "raw"])

    return run


def _steps(b: pa.RecordBatch, text_col: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about STEP_BYTES of text each, or one longer text."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(b[text_col]).fill_null(0).to_pylist()):
        size += n
        if size >= STEP_BYTES:
            yield b.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < b.num_rows:
        yield b.slice(start)


def _encode_rows(codec: Codec, text_col: str, with_ids: bool, chunk: int, overlap: int):
    """Rows with their results."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        rest = [n for n in b.schema.names if n != text_col or with_ids]
        n, pieces, ids, raw, all_ids = [], [], [], [], []
        for t in b[text_col]:
            got, k = _pieces(codec, t.as_py() or "", chunk, overlap)
            n.append(len(got))
            pieces.append(k)
            ids.append(hashlib.sha256(codec.joined(got)).hexdigest())
            raw.append(hashlib.sha256(codec.decode(got)).hexdigest())
            if with_ids:
                all_ids.append(np.array(got, np.int32))
        cols = [*(b[c] for c in rest), pa.array(n, pa.int64()), pa.array(pieces, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())]
        names = [*rest, "n_tokens", "n_pieces", "ids_sha256", "decoded_sha256"]
        if with_ids:
            cols.append(pa.array(all_ids, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _steps(b, text_col):
                yield one(part)
        release_memory()

    return run


def _long_texts(docs: DataFrame, text_col: str, codec: Codec, part: int, chunk: int, overlap: int) -> DataFrame:
    """(key, ids, raw, n) of every distinct text longer than part. One plan: the exchange of the long texts is reused."""
    text = named(text_col)
    long = docs.where(F.char_length(text) > part).select(F.unhex(F.sha2(text, 256)).alias("key"), text.alias("text")).dropDuplicates(["key"])
    size = F.char_length("text")
    last = ((size - 1) / part).cast("int")
    nos = long.withColumn("no", F.explode(F.sequence(F.lit(0), last)))
    parts = nos.select(
        "key", "no", (F.col("no") * part + part + overlap >= size).alias("last"), F.substring("text", F.col("no") * part + 1, F.lit(part + overlap)).alias("piece")
    )
    marks = parts.repartition("key", "no").mapInArrow(
        _seam_marks(codec.pattern, part, overlap), "key binary, no int, heads array<bigint>, tails array<bigint>"
    )
    right = marks.select("key", (F.col("no") - 1).alias("no"), "heads")
    seams = marks.select("key", "no", "tails").join(right, ["key", "no"]).select(
        "key", "no", F.array_min(F.array_intersect("tails", "heads")).alias("cut")
    )
    seams = seams.where("cut IS NOT NULL").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("no", "cut"))).alias("cuts"))
    # Past the first seam that is missing no part is anchored.
    anchored = F.transform(F.filter("cuts", lambda x, i: x["no"] == i), lambda x: x["cut"])
    spans = long.join(seams, "key", "left").withColumn(
        "at", F.concat(F.array(F.lit(0).cast("long")), F.coalesce(anchored, F.array().cast("array<bigint>")), F.array(size.cast("long")))
    )
    spans = spans.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("at") - 1)))
    start, end = F.element_at("at", F.col("i")), F.element_at("at", F.col("i") + 1)
    pieces = spans.select("key", start.alias("start"), F.substring("text", (start + 1).cast("int"), (end - start).cast("int")).alias("piece"))
    coded = pieces.repartition("key", "start").mapInArrow(
        _encode_pieces(codec, chunk, overlap), "key binary, start bigint, n bigint, pieces bigint, ids binary, raw binary"
    )
    return coded.groupBy("key").agg(
        F.sum("n").alias("n"), F.sum("pieces").alias("pieces"), F.array_sort(F.collect_list(F.struct("start", "n", "ids", "raw"))).alias("p")
    )


def encode(
    docs: DataFrame,
    codec: Codec,
    *,
    text_col: str = "text",
    chunk_chars: int = CHUNK_CHARS,
    overlap: int = OVERLAP,
    part_chars: int = PART_CHARS,
    with_ids: bool = False,
) -> DataFrame:
    """docs with n_tokens, n_pieces, ids_sha256, decoded_sha256; with_ids adds ids and keeps the text.

    Without with_ids the text column is dropped from the result.
    """
    if overlap >= min(chunk_chars, part_chars):
        raise ValueError("overlap must be smaller than chunk_chars and part_chars")
    ship_package(docs.sparkSession)
    docs = without_reserved(docs, "_bpe_").drop("n_tokens", "n_pieces", "ids_sha256", "decoded_sha256", *["ids"] * with_ids)
    fields = [f for f in docs.schema if f.name != text_col or with_ids]
    # The workers see columns by place, as Spark's Arrow functions take no dotted names.
    places = {f.name: f"c{i}" for i, f in enumerate(docs.schema)}
    kept = [f"{places[f.name]} {f.dataType.simpleString()}" for f in fields]
    more = ["n_tokens bigint", "n_pieces bigint", "ids_sha256 string", "decoded_sha256 string"] + ["ids array<int>"] * with_ids
    names = [f.name for f in fields] + [m.split(" ")[0] for m in more]
    is_long = F.coalesce(F.char_length(named(text_col)) > part_chars, F.lit(False))
    run = _encode_rows(codec, places[text_col], with_ids, chunk_chars, overlap)
    rows = docs.where(~is_long).toDF(*places.values()).mapInArrow(run, ", ".join(kept + more)).toDF(*names)
    long = _long_texts(docs, text_col, codec, part_chars, chunk_chars, overlap)
    # "," joins what is not empty: a piece always has ids.
    joined = F.array_join(F.transform("p", lambda x: x["ids"].cast("string")), ",")
    # Raw bytes are no valid UTF-8 piece by piece; hex is, and joins by concatenation.
    raw = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["raw"])), ""))
    long = long.select(
        F.col("key").alias("_bpe_key"), F.col("n").alias("n_tokens"), F.col("pieces").alias("n_pieces"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2(raw, 256).alias("decoded_sha256"),
        *([F.transform(F.split(joined, ","), lambda x: x.cast("int")).alias("ids")] * with_ids),
    )
    keyed = docs.where(is_long).withColumn("_bpe_key", F.unhex(F.sha2(named(text_col), 256))).select(*(named(f.name) for f in fields), "_bpe_key")
    # By place: both have the columns of docs, then the results.
    return rows.union(keyed.join(long, "_bpe_key").drop("_bpe_key"))


def decode(coded: DataFrame, codec: Codec, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """coded with the bytes of its ids; null ids decode to no bytes."""
    ship_package(coded.sparkSession)
    coded = coded.drop(out_col)
    at = coded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = pa.array([codec.decode(x or []) for x in b.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, raw], names=[*b.schema.names, "raw"])

    plain = coded.toDF(*(f"c{i}" for i in range(len(coded.columns))))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(run, f"{kinds}, raw binary").toDF(*coded.columns, out_col)
