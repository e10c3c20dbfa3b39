"""Each stage of the pipeline, on what the stage before it kept, against brute force."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_jaccard import _brute as near_brute
from test_line_dedup import _brute as lines_brute
from test_mixing import _targets

import corpus_pipeline as P
from lodestone.llm.bpe import Codec

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before the first and after each stage."""
    base = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", None, None), (9002, "", None, "src1", 0), (9003, "12 34 !!", "en", "src1", 8), (9004, "the of and in", None, None, 13)], docs.schema)
    docs = docs.unionByName(odd)
    out = [docs.collect()]
    for i, (_, f) in enumerate(P.STAGES):
        f(spark, docs, str(base)).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
        out.append(docs.collect())
        if i < len(P.STAGES) - 1:
            assert docs.columns == COLUMNS
    return out


def test_language_keeps_documents_with_words(stages):
    before, after = ({r["doc_id"] for r in x} for x in stages[:2])
    assert after <= before and before - after == {9001, 9002, 9003}


def test_lines(stages):
    gone = lines_brute([r["text"] for r in stages[1]])
    want = {}
    for r in stages[1]:
        t = "\n".join(x for i, x in enumerate(r["text"].split("\n")) if i not in set(gone.get(r["text"], [])))
        if t.strip(" \t\n\r\f\v") or not gone.get(r["text"]):
            want[r["doc_id"]] = t
    assert {r["doc_id"]: r["text"] for r in stages[2]} == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2])


def test_near_copies(stages):
    rows = near_brute([(r["doc_id"], r["text"]) for r in stages[2]], P.NEAR_WORDS, P.NEAR_PERCENT)
    assert {str(r["doc_id"]) for r in stages[3]} == {d for d, n, c in rows if d == c or n == 0}


def test_mix(stages):
    size = lambda r: len(r["text"].split())
    sizes, taken = Counter(), Counter()
    for r in stages[3]:
        sizes[r["source"]] += size(r)
    for r in stages[4]:
        taken[r["source"]] += size(r)
    most = max(map(size, stages[3]))
    for k, t in _targets(sizes).items():
        assert abs(taken[k] - t) <= most
    assert max(Counter(r["doc_id"] for r in stages[4]).values()) <= 3


def test_tokens(stages):
    codec = Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = {r["doc_id"]: r["text"] for r in stages[4]}
    assert len(stages[5]) == len(stages[4])
    for r in stages[5]:
        assert r["ids"] == codec.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_run(spark, sf):
    out = P.run(spark, sf)
    assert out.where(F.col("n_tokens") > 0).count() == out.count() > 100


def test_repeated_rows_and_empty_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 40")
    twice = P.one_of_near_copies(spark, docs.unionByName(docs), str(tmp_path))
    once = P.one_of_near_copies(spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in twice.collect()) == sorted(r["doc_id"] for r in once.collect())
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_null_and_repeated_ids(spark, tmp_path):
    """Rows that share an id, or have none, but no words, all stay; of near copies one stays."""
    schema = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema
    prose = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    texts = [(None, prose(0)), (None, prose(1)), (None, prose(2)), (None, prose(2)), (7, prose(3)), (7, prose(4)), (7, prose(5)), (9, prose(5)), (3, prose(6)), (None, prose(6)), (3, prose(7)), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in texts], schema)
    got = [(r["doc_id"], r["text"]) for r in P.one_of_near_copies(spark, docs, str(tmp_path)).collect()]
    want = [(None, prose(0)), (None, prose(1)), (None, prose(2)), (7, prose(3)), (7, prose(4)), (7, prose(5)), (3, prose(6)), (3, prose(7)), (None, None), (None, "")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_tables_between_steps_are_zstandard(spark):
    """Snappy copies of the texts took the near-copy stage over its disk."""
    from lodestone.runtime import Scratch

    files = Scratch(spark, "codec").keep(spark.range(9), "t").inputFiles()
    assert files and all(f.endswith(".zstd.parquet") for f in files)


def test_counted_region_keeps_its_margin():
    from lodestone.llm.jaccard import SMALL, prefix_length, region_limit

    for percent in range(70, 100):
        share = int(region_limit(percent)) / 2**64
        assert prefix_length(SMALL, percent) / SMALL <= share + 0.01
    assert int(region_limit(80)) / 2**64 < 0.31
