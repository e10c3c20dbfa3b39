import math
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import license as L

TERM = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
MIT, GPL = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
TEXT = {k: max((t for n, t in L.NOTICES if n == k), key=len) for k, _ in L.NOTICES}
HOLDER = "Copyright (c) 2020 Jane Doe\n\n"
FILES = [
    ("/a/LICENSE", MIT), ("/a/x.py", "code here\nmore code"), ("/a/b/y.py", "nothing"), ("/a/b/c/LICENSE.txt", GPL), ("/a/b/c/z.py", None), ("/a/b/c/own.py", "first\n" + MIT + "\nrest " * 400),
    ("/d/COPYING", "what is this"), ("/d/z.py", ""), ("/e/short", MIT + "\nbye"), ("/e/other", "x y z"), ("/e/short2", GPL), (None, GPL), ("top.py", "x"), ("/a/x.py", "code here\nmore code"),
    ("/f/many.py", "\n".join(TEXT["Apache-2.0"].split(". ")) + "\nprose follows here\n" * 50), ("/g/long.py", "word " * 40_000 + "\n" + GPL), ("/g/part.py", "licensed under nobody's version of a general work"),
    ("/h/two.py", "# " + TEXT["Apache-2.0"] + "\n\ncode = 1\n\n" + TEXT["MIT"] + "\nmore = 2"), ("/h/bsd2", HOLDER + TEXT["BSD-2-Clause"]), ("/h/bsd3", HOLDER + TEXT["BSD-3-Clause"]),
]


def _terms(text):
    return TERM.findall(text.lower())


def _vec(bag, idf, unseen):
    v = {}
    for t in bag:
        v[t] = v.get(t, 0) + idf.get(t, unseen)
    return v


def _norm(v):
    return math.sqrt(sum(w * w for w in v.values()))


def _weights(files):
    texts = [t for _, t in files if t is not None]
    bags = [_terms(x) for _, x in L.TEMPLATES]
    vocab = {t for b in bags for t in b}
    df = {t: 0 for t in vocab}
    for x in texts:
        for t in vocab & set(_terms(x)):
            df[t] += 1
    idf = {t: math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in vocab}
    unseen = math.log(1 + len(texts)) + 1
    vs = [_vec(b, idf, unseen) for b in bags]
    return bags, idf, unseen, [{t: w / _norm(v) for t, w in v.items()} for v in vs]


def _brute(files):
    """Own licences by the rule, span by span and term by term: (licences, best score, first line)."""
    bags, idf, unseen, tv = _weights(files)
    laid = []
    for b, v in zip(bags, tv, strict=True):
        rest, marks = 1.0, []
        for t, w in sorted(v.items(), key=lambda x: (-x[1], x[0])):
            if rest < L.THRESHOLD**2 - 1e-9:
                break
            marks.append(t)
            rest -= w * w
        once = [t for t in marks if b.count(t) == 1] or marks
        laid.append({t: b.index(t) for t in once})
    out = {}
    for x in {t for _, t in files if t is not None}:
        where = [(t, i) for i, line in enumerate(x.split("\n")) for t in _terms(line)]
        bag = [t for t, _ in where]
        spans = {(i, max(0, p - at[t]), min(len(bag), p - at[t] + len(bags[i]))) for i, at in enumerate(laid) for p, t in enumerate(bag) if t in at}
        best = {}
        for i, lo, hi in spans:
            s = _vec(bag[lo:hi], idf, unseen)
            c = round(sum(w * tv[i].get(t, 0) for t, w in s.items()) / _norm(s), 6)
            if c >= L.THRESHOLD:
                for p in range(lo, hi):
                    best[p] = max(best.get(p, (0,)), (c, hi - lo, -lo, -i))
        wins = {r for r in best.values() if 2 * list(best.values()).count(r) > r[1]}
        if wins:
            first = min(-r[2] for r in wins)
            out[x] = " AND ".join(sorted({L.TEMPLATES[-r[3]][0] for r in wins})), max(r[0] for r in wins), where[first][1]
    return out


def test_as_brute_force(spark):
    df = spark.createDataFrame(FILES, "path string, text string").withColumn("licence", F.lit("clash")).withColumn("doc", F.lit(1)).withColumn("_lic_own", F.lit(2)).withColumn("a.b", F.lit(3)).repartition(3)
    out = L.scan(df)
    assert out.columns[:5] == ["path", "text", "licence", "doc", "a.b"]
    out = out.collect()
    assert len(out) == len(FILES)
    want = _brute(FILES)
    assert len(want) >= 9
    for r in out:
        w = want.get(r["text"])
        assert (r["_lic_own"], r["_lic_line"]) == ((w[0], w[2]) if w else (None, None)), r["path"]
        if w:
            assert abs(r["_lic_score"] - w[1]) < 2e-6


def _own(spark, texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [(f"p{i}", f"plain words {i} and nothing else") for i in range(30)], "path string, text string")
    got = {r["path"]: r["_lic_own"] for r in L.scan(df).collect()}
    return [got[str(i)] for i in range(len(texts))]


def test_every_template_is_found_wherever_it_stands(spark):
    """Wrapped, commented, in the middle of a line, with a holder before it."""
    words = [t.split() for _, t in L.TEMPLATES]
    wrapped = ["\n".join(" * " + " ".join(w[i : i + 7]) for i in range(0, len(w), 7)) for w in words]
    inline = [f"Copyright 2020 Jane Doe. {t} Some words follow it." for _, t in L.TEMPLATES]
    names = [n for n, _ in L.TEMPLATES]
    assert _own(spark, wrapped) == names
    assert _own(spark, inline) == names


@pytest.mark.parametrize("name", ["MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "Zlib", "Unlicense", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "AGPL-3.0"])
def test_licence_texts_are_told_apart(name):
    """The best span of a text under other licences' templates is below its own."""
    bags, idf, unseen, tv = _weights([("x", t) for _, t in L.NOTICES])
    s = _vec(_terms(TEXT[name]), idf, unseen)
    scores = {}
    for (n, _), v in zip(L.TEMPLATES, tv, strict=True):
        scores[n] = max(scores.get(n, 0), sum(w * v.get(t, 0) for t, w in s.items()) / _norm(s))
    assert max(scores, key=scores.get) == name and sorted(scores.values())[-2] < 0.9999


def test_licences_of_one_file_and_edits(spark):
    edited = TEXT["MIT"].replace("publish, ", "").replace("sublicense", "sublicence").replace("OTHERWISE", "OTHER WISE")
    got = _own(spark, [HOLDER + TEXT["BSD-2-Clause"], TEXT["Apache-2.0"] + "\n\nx = 1\n" * 9 + TEXT["MIT"], edited, "A licence sentence in prose, which nobody grants.", "/* SPDX-License-Identifier: GPL-2.0-or-later */\nint x;"])
    assert got == ["BSD-2-Clause", "Apache-2.0 AND MIT", "MIT", None, "GPL-2.0"]


def test_no_good_span_at_any_place_is_missed(spark):
    """Looks at every span of a template's length at every place: what reaches 0.9 anywhere has a licence."""
    texts = [t for _, t in FILES if t and len(t) < 5_000]
    bags, idf, unseen, tv = _weights([("x", t) for t in texts])
    got = {r["text"]: r["_lic_own"] for r in L.scan(spark.createDataFrame([("x", t) for t in texts], "path string, text string")).collect()}
    for x in texts:
        bag = _terms(x)
        for b, v in zip(bags, tv, strict=True):
            for lo in range(max(1, len(bag) - len(b) + 1)):
                s = _vec(bag[lo : lo + len(b)], idf, unseen)
                if s and sum(w * v.get(t, 0) for t, w in s.items()) / _norm(s) >= 0.9:
                    assert got[x] is not None, x


def test_nearest_ancestor(spark):
    out = {r["path"]: r for r in L.scan(spark.createDataFrame(FILES, "path string, text string")).collect()}
    get = lambda p: (out[p]["_lic_from"], out[p]["_lic_licence"])
    assert get("/a/x.py") == ("/a", "MIT") and get("/a/b/y.py") == ("/a", "MIT")
    assert get("/a/b/c/z.py") == ("/a/b/c", "GPL-3.0") and out["/a/b/c/own.py"]["_lic_licence"] == "MIT"
    assert get("/d/z.py") == (None, None) and not out["/d/COPYING"]["_lic_is_file"]
    assert get("/e/other") == ("/e", "GPL-3.0 AND MIT")
    assert get("top.py") == (None, None) and out[None]["_lic_own"] == "GPL-3.0" and out[None]["_lic_inherited"] is None
    assert not out["/g/long.py"]["_lic_is_file"] and out["/g/long.py"]["_lic_own"] == "GPL-3.0"
    assert out["/h/two.py"]["_lic_own"] == "Apache-2.0 AND MIT" and out["/h/two.py"]["_lic_is_file"]


def test_empty_table(spark):
    assert L.scan(spark.createDataFrame([], "path string, text string")).count() == 0
