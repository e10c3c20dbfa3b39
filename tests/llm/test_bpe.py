import hashlib
import random

import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from lodestone.llm.bpe import Codec, boundaries, cuts, decode, encode

WORDS = "The quick brüne fox's   jumps\n\n\tover 12345 dogs, they'll say: \"¡olé!\" — 'dd 're  "
TEXTS = [None, "", " ", "a", "x" * 900, " " * 700, "\n" * 500 + "end", WORDS * 40, "é" * 650, "a b" * 300, "12" * 400 + " tail", ("z" * 300 + "  \n y") * 5, "😀 👩‍👩‍👧" * 80]
TEXTS += ["a" + "7" * 600 + " b", "they're " * 200, "'" * 333 + "re", "\r\n" * 400 + "x y z" * 50]
DIGITS = r"""'s|'re| ?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def codec():
    return Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def digits():
    return Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), DIGITS)


def _check(codec, rows, out):
    texts = {i: t or "" for i, t, _ in rows}
    assert len(out) == len(rows)
    for r in out:
        t = texts[r["doc_id"]]
        ids = codec.encode(t)
        assert r["n_tokens"] == len(ids), r["doc_id"]
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), r["doc_id"]
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize(("chunk", "overlap", "part"), [(64, 24, 200), (50, 49, 10_000), (100, 40, 101), (1_024, 128, 262_144)])
def test_as_the_library(spark, codec, chunk, overlap, part):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(7, WORDS * 40, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").withColumn("_bpe_key", F.lit(1)).withColumn("a.b", F.lit(2)).repartition(3)
    out = encode(docs, codec, chunk_chars=chunk, overlap=overlap, part_chars=part)
    assert out.columns[:2] == ["doc_id", "a.b"]
    _check(codec, rows, out.collect())


@pytest.mark.parametrize(("chunk", "overlap", "part"), [(63, 24, 10_000), (63, 17, 130)])
def test_a_pattern_that_counts_digits(spark, digits, chunk, overlap, part):
    """Chunks of one long number agree with each other but not with the text."""
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x int").repartition(2)
    _check(digits, rows, encode(docs, digits, chunk_chars=chunk, overlap=overlap, part_chars=part).collect())


def test_cuts_are_true_boundaries():
    g = random.Random(5)
    for pattern in (public_tokenizers.PATTERN, DIGITS):
        p = regex.compile(pattern)
        for _ in range(300):
            t = "".join(g.choice(["a", "'", "re", "s", "1", "7", " ", "\n", "é", "!", "word ", "  "]) for _ in range(g.randrange(400)))
            true = set(boundaries(p, t, 0, len(t)))
            got = cuts(p, t, g.choice([20, 33]), 19)
            assert set(got) <= true and got == sorted(set(got)), t


def test_endless_words_take_linear_time():
    p = regex.compile(public_tokenizers.PATTERN)
    assert cuts(p, "x" * 1_000_000) == []
    assert len(cuts(p, "x" * 100_000 + " ordinary words go on" * 5_000)) > 60  # cuts resume within twice the endless word


def test_most_documents_have_seams(spark, codec):
    """With production parameters most real documents go through stitching."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"], 0) for r in docs.collect()]
    out = encode(docs, codec).collect()
    _check(codec, rows, out)
    assert sum(r["n_pieces"] > 1 for r in out) > len(out) / 2


def test_round_trip(spark, codec):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    coded = encode(docs, codec, chunk_chars=64, overlap=24, part_chars=300, with_ids=True)
    for r in decode(coded, codec).collect():
        assert bytes(r["decoded"]).decode() == (r["text"] or "")
        assert r["ids"] == codec.encode(r["text"] or "")


def test_empty_table(spark, codec):
    assert encode(spark.createDataFrame([], "doc_id long, text string"), codec).count() == 0
