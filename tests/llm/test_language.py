import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import language as L
from lodestone.runtime import Scratch


def test_counts_do_not_depend_on_steps(monkeypatch):
    texts = ["", "a", "Été à la plage 123 !!", "the quick brown fox " * 40, "\x00퟿😀", "x" * 999]
    whole = L.counts(texts)
    for i, t in enumerate(texts):
        clean = "".join(c if "a" <= c <= "z" or ord(c) >= 170 else " " for c in t.lower())
        while "  " in clean:
            clean = clean.replace("  ", " ")
        assert whole[i].sum() == sum(max(0, len(clean) - n + 1) for n in L.GRAMS), i
    # A step boundary never loses or repeats letters' n-grams.
    plain = ["abcdefghij" * 30]
    whole = L.counts(plain)
    monkeypatch.setattr(L, "STEP_CHARS", 64)
    stepped = L.counts(plain)
    assert (stepped >= whole).all() and np.abs(stepped - whole).sum() <= 3 * (300 // 64)


def _grams(text):
    """Places of a text's n-grams, one at a time."""
    clean = re.sub(" +", " ", "".join(c if "a" <= c <= "z" or ord(c) >= 170 else " " for c in text.lower()))
    out = Counter()
    for n in L.GRAMS:
        for i in range(len(clean) - n + 1):
            h = 0
            for k, c in enumerate(clean[i : i + n]):
                h = (h * 0x100000001B3 + ord(c) + k + 1) % 2**64
            out[(h * 0x9E3779B97F4A7C15) % 2**64 >> (64 - L.DIM_BITS)] += 1
    return out


def _vector(text, idf):
    v = {p: math.log1p(n) * idf[p] for p, n in _grams(text).items()}
    norm = math.sqrt(sum(x * x for x in v.values())) or 1
    return {p: x / norm for p, x in v.items()}


def test_as_brute_force(spark, sf):
    """Frequencies, weights, nearest centroid and rejection of every document, in plain Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r for r in docs.collect()]
    model = L.train(docs.where(~L.held_out(F.col("doc_id"))))
    taught = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["lang"] is not None and r["text"] is not None]
    df = Counter(p for r in taught for p in _grams(r["text"]))
    idf = [math.log((1 + len(taught)) / (1 + df[p])) + 1 for p in range(L.DIM)]
    assert np.allclose(model.idf, idf, rtol=1e-5)
    # The centroids are a fixed point: each is the mean direction of the sampled texts that are nearest to it.
    for lang in set(model.names):
        mine = [_vector(t, idf) for t in {r["text"] for r in taught if r["lang"] == lang}]
        at = [i for i, n in enumerate(model.names) if n == lang]
        dense = np.zeros((len(mine), L.DIM))
        for i, v in enumerate(mine):
            dense[i, list(v)] = list(v.values())
        own = (dense @ model.matrix[at].T).argmax(axis=1)
        for j, i in enumerate(at):
            c = dense[own == j].mean(axis=0)
            assert (own == j).sum() == model.sizes[i] and np.allclose(c / np.linalg.norm(c), model.matrix[i], atol=1e-4)
    got = {r["doc_id"]: r for r in L.predict(docs, model).collect()}
    for r in rows:
        v = _vector(r["text"] or "", idf)
        cos = [sum(x * float(c[p]) for p, x in v.items()) for c in model.matrix]
        best = max(range(len(cos)), key=lambda i: cos[i])
        g = got[r["doc_id"]]
        limit = model.limits[best][int(math.log2(max(1, sum(_grams(r["text"] or "").values()))))]
        assert g["_lid_lang"] == model.names[best] and abs(g["_lid_score"] - cos[best]) < 1e-4
        assert g["_lid_rejected"] == (cos[best] < limit) or abs(cos[best] - limit) < 1e-4


@pytest.fixture(scope="module")
def real(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, L.train(docs.where(~L.held_out(F.col("doc_id"))), train_rows=300)


def test_held_out_accuracy(real):
    docs, model = real
    got = L.predict(docs, model)
    assert got.count() == docs.count()
    right = got.where(L.held_out(F.col("doc_id"))).agg(F.avg((F.col("lang") == F.col("_lid_lang")).cast("int")), F.sum(F.col("_lid_rejected").cast("int")), F.min("_lid_score"), F.max("_lid_score")).first()
    assert right[0] > 0.98 and right[1] <= 1 and 0 <= right[2] <= right[3] <= 1


def test_several_real_clusters(real):
    for lang in set(real[1].names):
        sizes = [n for k, n in zip(real[1].names, real[1].sizes, strict=True) if k == lang]
        assert len(sizes) >= 2 and min(sizes) >= L.LEAST_SHARE * sum(sizes) and sum(sizes) <= 300


@pytest.mark.parametrize("letters", ["bcdfghjklmnpqrstvwxz", "абвгдежзиклмнопрст", "".join(chr(0x4E00 + i) for i in range(3000))])
def test_junk_is_rejected_at_any_length(real, letters):
    g = random.Random(7)
    for n in (5, 10, 50, 200, 1000, 5000):
        texts = [" ".join("".join(g.choice(letters) for _ in range(g.randrange(2, 8))) for _ in range(n)) for _ in range(10)]
        assert real[1].predict(texts)[2].all(), n


def test_short_clean_texts_stay(real):
    """Few words from the middle of documents that were not taught are rarely rejected, and go to their language."""
    docs, model = real
    texts = [(" ".join(r["text"].split()[3 : 3 + n]), r["lang"]) for r in docs.where(L.held_out(F.col("doc_id"))).collect() for n in (5, 20) if r["text"] and len(r["text"].split()) > 30]
    langs, _, rejected = model.predict([t for t, _ in texts])
    assert rejected.mean() < 0.02 and np.mean([a == b for a, (_, b) in zip(langs, texts, strict=True)]) > 0.95


def test_sample_is_of_distinct_texts_and_bounded(spark):
    rows = [("en", "the same common text")] * 500 + [("en", f"text number {i}") for i in range(400)] + [("de", "ein text")] * 3
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    got = L.sample(df, 100, Scratch(spark, "s")).collect()
    en = [r["text"] for r in got if r["lang"] == "en"]
    assert len(en) == len(set(en)) == 100 and sum(r["lang"] == "de" for r in got) == 1


def test_sample_of_a_table_full_of_copies(spark):
    """However often texts repeat, so many distinct ones are drawn, those with the smallest hashes."""
    one = spark.range(2_000).select(F.lit("en").alias("lang"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    many = one.crossJoin(spark.range(50).select(F.col("id").alias("copy"))).drop("copy").repartition(4)
    drawn = lambda df, n: {r["text"] for r in L.sample(df, n, Scratch(spark, "s")).collect()}
    got = drawn(many, 1_000)
    by_hash = one.orderBy(F.xxhash64(F.xxhash64("text"))).limit(1_000)
    assert got == drawn(one, 1_000) == {r["text"] for r in by_hash.collect()}
    assert len(drawn(many, 5_000)) == 2_000


def test_edge_rows(spark):
    de, en = "der die das und nicht ein mit von auf für".split(), "the and of with that is was for on this".split()
    rows = [(i, " ".join((de if i < 40 else en)[(i * k + k) % 10] for k in range(30)), "de" if i < 40 else "en", 0, 1) for i in range(80)]
    schema = "doc_id long, text string, lang string, score int, _lid_lang int"
    model = L.train(spark.createDataFrame(rows + rows + [(90, None, "en", 0, 1), (91, "x", None, 0, 1)], schema))
    odd = [(1, None), (2, ""), (3, "123 !?"), (4, "the and of"), (4, "the and of"), (5, "und nicht " * 200_000), (6, "漢字" * 50)]
    df = spark.createDataFrame([(*r, 9, 1, 1) for r in odd], "doc_id long, text string, score int, _lid_lang int, x int").withColumnRenamed("x", "a.b")
    out = L.predict(df, model)
    assert out.columns == ["doc_id", "text", "score", "a.b", "_lid_lang", "_lid_score", "_lid_rejected"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert [got[i]["_lid_lang"] for i in (1, 2, 3, 4, 5)] == ["und", "und", "und", "en", "de"]
    assert all(got[i]["_lid_rejected"] and got[i]["_lid_score"] == 0 for i in (1, 2, 3)) and got[6]["_lid_rejected"]
    assert not got[4]["_lid_rejected"] and got[5]["score"] == 9


def test_no_training_data(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = L.train(none)
    assert L.predict(none, model).count() == 0
    assert [r["_lid_lang"] for r in L.predict(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), model).collect()] == ["und"]
