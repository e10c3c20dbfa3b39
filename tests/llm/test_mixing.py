import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm.mixing import mix, mixed_rows


def _targets(sizes):
    names = sorted((k for k in sizes if k is not None)) + [None] * (None in sizes)
    w = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        total = sum(w[k] for k in free)
        over = {k for k in free if left * w[k] / total > 3 * sizes[k] + 1e-9}
        for k in over or free:
            out[k] = 3.0 * sizes[k] if over else left * w[k] / total
        left -= sum(out[k] for k in over)
        free -= over or free
    return out


ROWS = [(i, "w " * (i % 37 + 1) if i % 9 else None, "big") for i in range(300)]
ROWS += [(1000 + i, "a\tb c d", "tiny") for i in range(5)] + [(2000 + i, "x " * 50, None) for i in range(40)]
ROWS += [(3000, "", "nil"), (None, "one two", "big"), (None, "one two", "big"), (7, "other text", "big"), (4000, "y " * 20_000, "huge")]


def test_targets_and_budget(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("a.b", F.lit(1)).withColumn("_mix_key", F.lit(2)).repartition(5)
    out = mix(docs, bits=4)
    assert out.columns[:4] == ["doc_id", "text", "source", "a.b"]
    out = out.collect()
    assert len(out) == len(ROWS)
    sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in out:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert r["_mix_size"] == n and 0 <= r["_mix_copies"] <= 3
        sizes[r["source"]] += n
        taken[r["source"]] += n * r["_mix_copies"]
        most[r["source"]] = max(most[r["source"]], n)
    want = _targets(sizes)
    for r in out:
        assert r["_mix_source_size"] == sizes[r["source"]]
        assert r["_mix_target"] == pytest.approx(want[r["source"]])
    for k in sizes:
        assert abs(taken[k] - want[k]) <= most[k] / 2 + 1e-6
    again = mix(docs.repartition(2), bits=9).collect()
    key = lambda rs: sorted((str(r["doc_id"]), r["_mix_size"], r["_mix_copies"]) for r in rs)
    assert key(out) == key(again)


def test_rows_repeat(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    want = sum(r["_mix_copies"] for r in mix(docs).collect())
    got = mixed_rows(docs)
    assert got.columns == docs.columns and got.count() == want


def test_empty_and_wordless(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(none).count() == 0
    blank = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r["_mix_target"], r["_mix_copies"]) for r in mix(blank).collect()] == [(0.0, 0)] * 2
    assert math.isfinite(mix(blank).collect()[0]["_mix_target"])


def test_texts_are_not_shuffled(spark):
    """The plan's exchanges hold no text, whatever the mix returns."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    plan = mixed_rows(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan


def test_cut_as_a_running_sum(spark):
    """The rows taken are those that a running sum over all keys takes, in every source."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    out = mix(docs, bits=6).collect()
    md5 = lambda i: hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()
    for source in {r["source"] for r in out}:
        mine = [r for r in out if r["source"] == source]
        whole, target = mine[0]["_mix_source_size"], mine[0]["_mix_target"]
        epochs = int(target // whole) if whole else 0
        rest, sofar = target - epochs * whole, 0
        want, got = Counter(), Counter((str(r["doc_id"]), r["_mix_size"], r["_mix_copies"]) for r in mine)
        for r in sorted(mine, key=lambda r: (md5(r["doc_id"]), r["_mix_size"])):
            want[str(r["doc_id"]), r["_mix_size"], epochs + int(rest > 0 and 2 * sofar + r["_mix_size"] <= 2 * rest)] += 1
            sofar += r["_mix_size"]
        assert got == want
