"""Fill-in-middle: texts cut in three at unit boundaries and rearranged with sentinels.

Method: a sparse checkpoint index. While a text's units (lines) are counted, every STEP units the
byte and code-point offsets reached are recorded. A cut after u units is found by binary search
of the checkpoints and a rescan of at most STEP units from the one before it, so a text is decoded
nowhere and counted once, and the index holds one entry for each STEP units.

The cuts and the form come from a hash of the seed and the id, so reruns agree and no state is
shared. Sentinels stand for nothing else: a text that holds one stays plain. restore() gives the text
back from output and form.

Defined results: null counts as empty, and empty texts are plain; null ids take the cuts of the empty string; rows
that repeat an id and text give the same output; a carriage return is no line's end; an empty
table gives no rows; extra columns pass through unread, but for those whose name starts with _fim_,
which are dropped. Every row is made where it is read, without a shuffle; an Arrow batch's bytes are bounded by Spark.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text import all_of, named, without_reserved
from lodestone.runtime import release_memory, ship_package

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units between two checkpoints.
STEP = 64
SEED = "7"
#: Of 100 texts, those that are rearranged, and of 100 of these those in the order suffix, prefix, middle.
RATE, SPM_RATE = 100, 50


@dataclass(slots=True)
class Checkpoints:
    """Of a UTF-8 text: the number of its lines, and byte and code-point offsets after every step of them."""

    raw: bytes
    step: int
    units: int
    bytes_at: list[int]
    chars_at: list[int]

    def cut(self, units: int) -> tuple[int, int]:
        """Byte and code-point offset after so many units."""
        if units >= self.units:
            return len(self.raw), self.chars_at[-1]
        at = bisect_right(range(0, self.units + self.step, self.step), units) - 1
        byte = self.bytes_at[at]
        for _ in range(units - at * self.step):
            byte = self.raw.index(b"\n", byte) + 1
        return byte, self.chars_at[at] + code_points(self.raw[self.bytes_at[at] : byte])


def code_points(raw: bytes) -> int:
    """Code points of whole UTF-8 characters: the bytes that continue none."""
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


def checkpoints(raw: bytes, step: int = STEP) -> Checkpoints:
    """The index of a text, counted once; the last entry is the text's end."""
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    units = len(ends) + (len(raw) > 0 and not raw.endswith(b"\n"))
    at = [0, *ends[step - 1 :: step].tolist()]
    if at[-1] < len(raw):
        at.append(len(raw))
    chars, total = [0], 0
    for a, b in zip(at, at[1:], strict=False):
        total += code_points(raw[a:b])
        chars.append(total)
    return Checkpoints(raw, step, units, at, chars)


def draws(row_id: str, seed: str = SEED) -> list[int]:
    """Four numbers of 32 bits for a row."""
    h = hashlib.sha256(f"{seed}:{row_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def arranged(raw: bytes, row_id: str, seed: str, rate: int, spm_rate: int, step: int) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle, and the output of one text."""
    index = checkpoints(raw, step)
    n = index.units
    h1, h2, h3, h4 = draws(row_id, seed)
    if not raw or any(x.encode() in raw for x in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return n, "plain", None, None, raw
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    (a, a_chars), (b, b_chars) = index.cut(low), index.cut(high)
    p, m, s = PREFIX.encode() + raw[:a], MIDDLE.encode() + raw[a:b], SUFFIX.encode() + raw[b:]
    form = "spm" if h4 % 100 < spm_rate else "psm"
    return n, form, a_chars, b_chars - a_chars, s + p + m if form == "spm" else p + s + m


def fill_in_middle(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: str = SEED,
    rate: int = RATE,
    spm_rate: int = SPM_RATE,
    step: int = STEP,
) -> DataFrame:
    """docs with _fim_units, _fim_form (plain, psm or spm), _fim_prefix_chars, _fim_middle_chars, _fim_output."""
    if step < 1:
        raise ValueError("step must be at least 1")
    ship_package(docs.sparkSession)
    docs = without_reserved(docs, "_fim_")
    kinds = pa.struct([("n", pa.int64()), ("form", pa.string()), ("p", pa.int64()), ("m", pa.int64()), ("out", pa.string())])

    @F.arrow_udf("struct<n: bigint, form: string, p: bigint, m: bigint, out: string>")
    def make(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, texts in batches:
            yield pa.array(
                (
                    dict(zip(("n", "form", "p", "m", "out"), (*made[:4], made[4].decode()), strict=True))
                    for made in (arranged(t.as_buffer().to_pybytes() if t.is_valid else b"", i.as_py() or "", seed, rate, spm_rate, step) for i, t in zip(ids, texts, strict=True))
                ),
                kinds,
            )
            release_memory()

    out = docs.withColumn("_fim", make(named(id_col).cast("string"), named(text_col)))
    return out.select(
        *all_of(docs),
        F.col("_fim.n").alias("_fim_units"),
        F.col("_fim.form").alias("_fim_form"),
        F.col("_fim.p").alias("_fim_prefix_chars"),
        F.col("_fim.m").alias("_fim_middle_chars"),
        F.col("_fim.out").alias("_fim_output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(part[1], part[3], part[2])
    spm = F.concat(part[2], part[3], part[1])
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)
