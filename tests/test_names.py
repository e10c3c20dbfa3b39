"""The substring index finds what a scan of the names finds."""

import random

from lodestone.operators.names import build, search


def test_against_a_scan(spark, tmp_path):
    r = random.Random(5)
    names = [(i, "".join(r.choice("abcXYZ_é%") for _ in range(r.randint(0, 12)))) for i in range(400)] + [(900, None), (901, "getUser"), (902, "GETUSERS"), (903, "user_get")]
    path = str(tmp_path / "index")
    build(spark.createDataFrame(names, "id long, name string").repartition(5), path)
    words = {"one": ["a"], "two": ["bX", "Z"], "long": ["getuser", "user"], "none": ["qqq", "getuserx"], "mixed": ["abc", "%", "é_"], "empty": [""], "twice": ["user", "USER"]}
    queries = spark.createDataFrame([(q, i, w) for q, ws in words.items() for i, w in enumerate(ws)], "query string, pos int, word string")
    got = {}
    for x in search(spark, path, queries, n=7).collect():
        got.setdefault(x["query"], []).append((x["rank"], x["keyword_pos"], x["id"], x["name"]))
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    for q, ws in words.items():
        hits = []
        for i, n in names:
            places = [p for p, w in enumerate(ws) if w and n is not None and w.translate(lower) in n.translate(lower)]
            if places:
                hits.append((places[0], i, n))
        assert sorted(got.get(q, [])) == [(k + 1, *h) for k, h in enumerate(sorted(hits)[:7])], q


def test_only_the_folders_of_the_words_are_read(spark, tmp_path):
    path = str(tmp_path / "index")
    build(spark.createDataFrame([(i, f"name{i}") for i in range(300)], "id long, name string"), path)
    out = search(spark, path, spark.createDataFrame([("q", 0, "me29")], "query string, pos int, word string"))
    assert sorted(r["id"] for r in out.collect()) == [29, *range(290, 299)]
    assert "PartitionFilters: [isnotnull(bucket" in out._jdf.queryExecution().executedPlan().toString()
