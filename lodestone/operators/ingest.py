"""From files to chunks: language statistics, line frames, greedy merges and batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.functions import fixed as K
from lodestone.functions.text import chunk_hash, estimate_tokens, file_extension, language_of, line_count
from lodestone.operators.segments import segment


def language_stats(files: DataFrame) -> DataFrame:
    """files(path, content) -> (language, file_count, line_count, extensions, is_primary), most lines first."""
    f = files.select("path", language_of(F.col("path")).alias("language"), file_extension(F.col("path")).alias("ext"), line_count(F.col("content")).alias("lines"))
    g = f.groupBy("language").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("lines").alias("line_count"),
        F.array_sort(F.collect_set(F.concat(F.lit("."), F.when(F.col("ext") != "", F.col("ext"))))).alias("extensions"), F.min("path").alias("first"),
    )
    # One row a language: at most the fixed table's 29 and unknown.
    order = W.orderBy(F.desc("line_count"), "first")
    return g.withColumn("is_primary", F.row_number().over(order) == 1).drop("first")


def line_frames(files: DataFrame, *, max_tokens: int = K.CHUNK_TOKENS, overlap: int = K.OVERLAP_LINES, key: str = "path", text: str = "content") -> DataFrame:
    """Overlapping frames of lines: (key, ordinal, start_line, end_line, content).

    A frame holds max(50, max_tokens / 20) lines and starts frame - overlap lines after the
    last one; the frame that reaches the end is the last. A frame within its overlap would
    never advance, so it is taken to advance by one line.
    """
    frame = max(50, max_tokens // 20)
    step = max(1, frame - overlap)
    lines = F.split(F.regexp_replace(F.col(text), "\n$", ""), "\n")
    rows = files.where(F.coalesce(F.col(text), F.lit("")) != "").select(key, lines.alias("l"))
    n = F.size("l")
    last = F.greatest(F.ceil((n - frame) / step), F.lit(0)).cast("int")
    rows = rows.select(key, "l", n.alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("ordinal"))
    start = F.col("ordinal") * step
    return rows.select(
        key, "ordinal", (start + 1).alias("start_line"), F.least(start + frame, F.col("n")).alias("end_line"),
        F.array_join(F.slice("l", start + 1, F.lit(frame)), "\n").alias("content"),
    )


def split_frames(chunks: DataFrame, *, frame: int, key: list[str]) -> DataFrame:
    """Oversized declarations in frames of so many lines, without overlap."""
    lines = F.split("content", "\n")
    rows = chunks.select(*key, F.col("start_line").alias("_first"), lines.alias("l")).withColumn(
        "ordinal", F.explode(F.sequence(F.lit(0), ((F.size("l") - 1) / frame).cast("int")))
    )
    at = F.col("ordinal") * frame
    return rows.select(
        *key, "ordinal", (F.col("_first") + at).alias("start_line"), (F.col("_first") + F.least(at + frame, F.size("l")) - 1).alias("end_line"),
        F.array_join(F.slice("l", at + 1, F.lit(frame)), "\n").alias("content"),
    )


PARTS = "array<struct<at: int, start_line: int, end_line: int>>"


def file_lines(parts: Column, first: Column, last: Column) -> Column:
    """The runs of a file's lines, array<struct<start_line, end_line>>, that lines first to last of a merged chunk's content are.

    A citation over a merged chunk may stand for several runs. What is past a part's end is that end.
    """
    ends = F.concat(F.slice(F.transform(parts, lambda p: p["at"]), F.lit(2), F.size(parts)), F.array(F.lit(2**31 - 1)))
    spans = F.zip_with(parts, ends, lambda p, e: F.struct(p["at"].alias("at"), p["start_line"].alias("a"), p["end_line"].alias("b"), (e - 1).alias("to")))
    held = F.filter(spans, lambda p: (p["at"] <= last) & (p["to"] >= first))
    line = lambda p, k: F.greatest(p["a"], F.least(p["b"], p["a"] + k - p["at"]))
    return F.transform(held, lambda p: F.struct(line(p, F.greatest(first, p["at"])).alias("start_line"), line(p, F.least(last, p["to"])).alias("end_line")))


def merge_small(chunks: DataFrame, *, min_lines: int = K.MIN_CHUNK_LINES) -> DataFrame:
    """Left fold of a file's chunks: two neighbours that are both short become one block.

    chunks(file_path, language, seq, start_line, end_line, chunk_type, symbol_name, content).
    A file's chunks lie side by side in one sorted partition and pass one by one; only the open
    block is held. parts(at, start_line, end_line) tells, sorted by at, from which line of the
    content on each chunk stands and which lines of the file it is, as chunks need not touch.
    """
    names = ["file_path", "language", "start_line", "end_line", "chunk_type", "symbol_name", "content"]
    ints = [F.col(c).cast("int").alias(c) if c.endswith("_line") else F.col(c) for c in names]
    c = chunks.select(*ints, "seq").repartition("file_path", "language").sortWithinPartitions("file_path", "language", "seq").select(names)
    kinds = {f.name: f.dataType.simpleString() for f in c.schema}
    out = ", ".join(f"{n} {kinds.get(n, 'int')}" for n in [*names[:2], "ordinal", *names[2:]]) + f", parts {PARTS}"
    empty = chunks.sparkSession.createDataFrame([], out).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ordinal, head, body, parts = None, 0, [], [], []  # the open block: its first columns, contents and parts

        def row() -> dict:
            start, end, kind, symbol = head
            # A text without content stays null, as in a concatenation.
            text = None if any(x is None for x in body) else "\n".join(body)
            return {"file_path": key[0], "language": key[1], "ordinal": ordinal, "start_line": start, "end_line": end, "chunk_type": kind, "symbol_name": symbol, "content": text, "parts": parts}

        def part(start: int, end: int) -> dict:
            at = parts[-1]["at"] + (body[-1] or "").count("\n") + 1 if parts else 1
            return {"at": at, "start_line": start, "end_line": end}

        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(empty)
        for b in batches:
            rows = []
            for path, lang, start, end, kind, symbol, text in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if key != (path, lang):
                    if key is not None:
                        rows.append(row())
                    key, ordinal, head, parts = (path, lang), 0, [start, end, kind, symbol], []
                    parts, body = [part(start, end)], [text]
                elif head[1] - head[0] + 1 < min_lines and end - start + 1 < min_lines:
                    head[1], head[2] = end, "block"
                    parts.append(part(start, end))
                    body.append(text)
                else:
                    rows.append(row())
                    ordinal, head, parts = ordinal + 1, [start, end, kind, symbol], []
                    parts, body = [part(start, end)], [text]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
        if key is not None:
            yield pa.RecordBatch.from_pylist([row()], schema=schema)

    return c.mapInArrow(run, out)


def token_batches(rows: DataFrame, *, group: str, seq: str, text: str, most: int = K.MAX_BATCH_TOKENS) -> DataFrame:
    """rows with batch: a new one starts where the running token sum of a non-empty batch would pass most.

    The sum starts anew with each batch, as in a fold over a group's order; segments.segment deals a
    group over many tasks. Only keys and sizes are shuffled.
    """
    c = rows.select(group, seq, estimate_tokens(F.col(text)).cast("long").alias("tokens"))
    return segment(c, group=group, order=[seq, "tokens"], size="tokens", limit=most).withColumnRenamed("segment", "batch")


def with_chunk_hash(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_hash", chunk_hash(F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("content")))


def split_by_checkpoint(chunks: DataFrame, checkpoints: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits with result_json, misses) of chunks against what is stored; undecodable results are misses."""
    good = checkpoints.where(F.try_parse_json("result_json").isNotNull()).dropDuplicates(on)
    return chunks.join(good.select(*on, "result_json"), on), chunks.join(good.select(*on), on, "left_anti")
