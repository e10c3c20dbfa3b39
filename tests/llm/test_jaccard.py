import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import jaccard as J
from lodestone.llm.components import connected_components
from lodestone.runtime import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _set(t, n):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def _brute(rows, n, percent):
    sets = [_set(t, n) for _, t in rows]
    par = list(range(len(rows)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(rows)):
        for k in range(i):
            s = len(sets[i] & sets[k])
            if s and 100 * s >= percent * len(sets[i] | sets[k]):
                par[find(i)] = find(k)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), str(least.get(find(i)))) for i, (d, _) in enumerate(rows))


def _rows(seed, n=3):
    g = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É", "ß", "über"]
    rows, hot = [], [g.choice(vocab) for _ in range(40)]
    for b in range(14):
        base = [g.choice(vocab) for _ in range(g.choice([2, 5, 12, 40, 62, 68, 75, 150, 400]))]
        if b % 3 == 0:
            base = base + hot
        for _ in range(g.choice([1, 2, 9, 25])):
            w = list(base)
            for _ in range(g.choice([0, 0, 1, 1, 2, 4])):
                w[g.randrange(len(w))] = g.choice(vocab)
            if g.random() < 0.2:
                w = w[1:]
            t = g.choice([" ", "\n", "\t \r"]).join(w)
            rows.append((g.randrange(100_000), t.upper() if g.random() < 0.2 else t))
    return rows + [(100_001, None), (100_002, ""), (100_003, " \n"), (100_004, "one"), (100_005, "One"), (100_006, "one two"), (None, "one"), (None, "lone words here too"), (100_004, "one")]


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 3, 90), (2, 3, 80), (3, 5, 80), (4, 3, 30), (8, 3, 95)])
def test_as_brute_force(spark, seed, n, percent):
    rows = _rows(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("dig", F.lit(b"x")).withColumn("a.b", F.lit(2)).repartition(3)
    out = J.jaccard_components(df.withColumn("_jac_n", F.lit(7)), n_words=n, percent=percent)
    assert out.columns[:5] == df.columns
    assert sorted((str(r["doc_id"]), r["_jac_n"], str(r["_jac_component"])) for r in out.collect()) == _brute(rows, n, percent)


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = sorted((str(r["doc_id"]), r["_jac_n"], str(r["_jac_component"])) for r in J.jaccard_components(docs).collect())
    assert got == _brute(rows, 3, 90)


@pytest.mark.parametrize("percent", [40, 60])
def test_sets_of_common_tokens_only(spark, percent):
    """Large sets all of whose tokens many documents share still meet at low thresholds."""
    g = random.Random(percent)
    common = [f"c{i}" for i in range(260)]
    rows = []
    for i in range(24):
        keep = [w for w in common if g.random() < 0.85] if i % 2 else common[: 130 + i]
        rows.append((i, " ".join(keep + [f"own{i}_{k}" for k in range(10)])))
    out = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n_words=1, percent=percent)
    assert sorted((str(r["doc_id"]), r["_jac_n"], str(r["_jac_component"])) for r in out.collect()) == _brute(rows, 1, percent)


def test_thresholds_that_make_no_sense(spark):
    for percent in (0, 101):
        with pytest.raises(ValueError):
            J.jaccard_components(spark.createDataFrame([], "doc_id long, text string"), percent=percent)


def test_empty_table(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    g = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(200, x) for x in range(201, 260)] + [(g.randrange(300, 400), g.randrange(300, 400)) for _ in range(70)]
    par = {}

    def find(x):
        while par.setdefault(x, x) != x:
            x = par[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            par[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"), "cc").collect()
    assert {(r["node"], r["comp"]) for r in got} == {(x, find(x)) for x in list(par)} and len(got) == len(par)


def test_words_that_weak_hashes_confuse(spark):
    """The Thue-Morse word and its complement, alone and in otherwise equal texts; very long words; case and split ends."""
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, word[:1024]), (4, other[:1024]), (5, word.upper()), (6, "x " + word), (7, "x " + other), (8, "y" * 3_000_000), (9, "y" * 3_000_001), (10, "Y" * 3_000_000)]
    rows += [(20 + i, " ".join([f"w{i}x{k}" for k in range(30)] + [w])) for i, w in enumerate((word, other))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = J.jaccard_components(df).collect()
    assert sorted((str(r["doc_id"]), r["_jac_n"], str(r["_jac_component"])) for r in out) == _brute(rows, 3, 90)


def test_word_hashes_do_not_depend_on_steps(monkeypatch):
    text = " ".join(f"Wörd{i}\t{i}" for i in range(500)).encode()
    whole = J.shingle_sets([text, b"", b"one", text], 3)
    monkeypatch.setattr(J, "STEP_BYTES", 50)
    stepped = J.shingle_sets([text, b"", b"one", text], 3)
    assert all((a[0] == b[0]).all() and a[1] == b[1] for a, b in zip(whole, stepped, strict=True)) and len(whole[0][0]) == 998


def test_sets_too_small_for_other_links():
    for percent in (50, 80, 90, 95):
        n = J.least_size(percent)
        assert 100 * n >= percent * (n + 1) and (n == 1 or 100 * (n - 1) < percent * n)
