import hashlib
import math
import re
import zlib
from collections import Counter

from compare import duck, same
from pyspark.sql import functions as F

from lodestone.llm.queries import op12_resample
from lodestone.llm.resample import least_grams, resample
from lodestone.llm.sql import op12_resample as SQL

DOCS = [(i, f"The n{i % 7} quick brown fox no {i % 13} jumps OVER a lazy dog; " * (i % 5) + "Ünïcode ÄB x-y_z 42") for i in range(120)]
DOCS += [(200, None), (201, ""), (202, " .;! "), (203, "one"), (204, "two words"), (None, DOCS[3][1]), (7, DOCS[9][1]), (7, DOCS[9][1]), (300, "w " * 50_000)]
AIM = [(0, "a lazy dog jumps over the fox"), (1, None), (2, "quick quick fox")]


def _brute(docs, aim, orders, buckets, min_words, percent):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})

    def grams(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, orders + 1) for i in range(len(w) - k + 1)]

    found = [(i, t, *grams(t)) for i, t in docs]
    s, t = Counter(b for *_, g in found for b in g), Counter(b for _, x in aim for b in grams(x)[1])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in s}
    out = []
    for i, text, n, g in found:
        weight = sum(gain[b] for b in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, text, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= min_words])
    may = sorted((x for x in out if x[5]), key=lambda x: (-x[4], x[0] is None, x[0]))
    ranks = {id(x): k + 1 for k, x in enumerate(may[: percent * len(may) // 100])}
    return sorted(((*x[:5], ranks.get(id(x))) for x in out), key=repr)


def _rows(df):
    return sorted(((r["doc_id"], r["text"], r["_res_n"], r["_res_weight"], r["_res_score"], r["_res_rank"]) for r in df.collect()), key=repr)


def test_against_brute_force(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(5)
    aim = spark.createDataFrame(AIM, "item_id long, text string")
    for orders, buckets, least, percent in ((2, 10_000, 20, 25), (1, 64, 1, 100), (3, 500, 3, 50)):
        got = resample(docs, aim, max_order=orders, buckets=buckets, min_words=least, percent=percent)
        assert _rows(got) == _brute(DOCS, AIM, orders, buckets, least, percent)


def test_empty_tables(spark):
    docs, none = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert resample(none, docs).count() == 0
    assert _rows(resample(docs, none)) == _brute(DOCS, [], 2, 10_000, 20, 25)
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [(r["_res_n"], r["_res_weight"], r["_res_rank"]) for r in resample(blank, docs).collect()] == [(0, 0, None)] * 2


def test_clashing_columns(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumns({"a.b": F.lit(1), "n": F.lit(2), "bucket": F.lit("x"), "_res_key": F.lit(3), "copies": F.lit(4)})
    got = resample(docs.withColumnRenamed("doc_id", "my.id").withColumnRenamed("text", "my.text"), docs, id_col="my.id", text_col="my.text")
    assert got.columns == ["my.id", "my.text", "a.b", "n", "bucket", "copies", "_res_n", "_res_weight", "_res_score", "_res_rank"]
    assert got.count() == len(DOCS)


def test_one_exchange_for_the_position_table(spark):
    """Words are never shuffled: explode and window stand on the exchange of the texts."""
    from lodestone.llm.resample import bucket_counts, distinct_texts

    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    plan = bucket_counts(distinct_texts(F.col("text"), docs))._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange ") == 1 and plan.index("Window") < plan.index("posexplode") < plan.index("Exchange ")


def test_least_grams():
    assert [least_grams(20, k) for k in (1, 2, 3)] == [20, 39, 57] and least_grams(1, 3) == 1


def test_query(spark, sf):
    same(op12_resample(spark, sf), duck(sf).execute(SQL))


def test_no_hash_table_beside_the_window(spark):
    """A hash table of a task's n-grams does not spill for the window, which then finds no memory (F1)."""
    from lodestone.llm.resample import bucket_counts, distinct_texts

    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    plan = bucket_counts(distinct_texts(F.col("text"), docs))._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "HashAggregate" not in plan[: plan.index("Window")]
