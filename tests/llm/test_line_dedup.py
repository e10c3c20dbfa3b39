import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lodestone.llm import line_dedup as L


def _is_field(t):
    return bool(re.search(r"[0-9@]|://", t))


def _mask(line):
    """A line's tokens as they are compared, and its path."""
    raw = [t for t in re.split(r"[ \t\r\f\x0b]+", line) if t]
    masked = tuple("<*>" if _is_field(t) else t for t in raw)
    words = sum(any(c.isalpha() for c in t) and not _is_field(t) for t in raw)
    return (masked if words >= max(L.DEPTH, -(-len(raw) * 7 // 10)) else tuple(raw)), (len(raw), masked[: L.DEPTH])


def _enough(n):
    return 100 if n < 3 else 2 if n >= 20 else 5


def _brute(texts):
    """For each text the numbers of the lines it loses."""
    md5 = {t: hashlib.md5(t.encode()).digest() for t in texts if t is not None}
    lines = [(t, i, *_mask(x)) for t in md5 for i, x in enumerate(t.split("\n")) if len(x.split()) >= L.MIN_TOKENS or any(c.isalpha() for c in x)]
    docs, kinds = defaultdict(set), defaultdict(set)
    for t, _, k, leaf in lines:
        docs[leaf].add(t)
        kinds[leaf].add(k)
    branches = defaultdict(list)
    for leaf, ks in kinds.items():
        if len(docs[leaf]) < _enough(leaf[0]):
            continue
        n = Counter((p, x) for k in ks for p, x in enumerate(k) if p >= L.DEPTH and x != "<*>")
        for k in ks:
            mine = [(n[p, x], p, x.encode()) for p, x in enumerate(k) if n[p, x] >= _enough(leaf[0])]
            if mine:
                branches[leaf, min(mine)].append(k)
    template = {}
    for (leaf, b), ks in branches.items():
        pos = {}
        for p in range(leaf[0]):
            tok, n = max(Counter(k[p] for k in ks).items(), key=lambda x: (x[1], x[0].encode()))
            if n >= L.SHARE * len(ks):
                pos[p] = tok
        if len(ks) > 1 and sum(x != "<*>" for x in pos.values()) >= max(L.DEPTH + 1, -(-leaf[0] * 7 // 10)):
            for k in ks:
                if all(k[p] == x for p, x in pos.items()):
                    template[leaf, k] = b
    uses = defaultdict(set)
    name = lambda k, leaf: (leaf, template.get((leaf, k), k))
    for t, _, k, leaf in lines:
        uses[name(k, leaf)].add(t)
    first = {n: min(ts, key=md5.get) for n, ts in uses.items() if len(ts) >= _enough(n[0][0])}
    gone = defaultdict(list)
    for t, i, k, leaf in lines:
        if name(k, leaf) in first and first[name(k, leaf)] != t:
            gone[t].append(i)
    return gone


TEXTS = [f"Intro words of text {chr(97 + i)}{chr(97 + i)}\nPosted by user{i} on page {i} today\nAll rights reserved here\nUnique line number {'x' * i} of this one\n\nA." for i in range(12)]
TEXTS += [f"Dear reader named {n} welcome to our little site\nSome other prose {n} {n} goes here and on" for n in ("anna", "bob", "cleo", "dave", "eve", "fay")]
TEXTS += ["All rights reserved here", "All rights reserved here\n\nAll rights reserved here", "", "\n", None, "one " * 30_000, "word\n" * 3_000, TEXTS[0], TEXTS[0]]


def test_as_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("leaf", F.lit(2)).withColumn("a.b", F.lit(3)).withColumn("_line_doc", F.lit(4)).repartition(3)
    out = {r["doc_id"]: r for r in L.drop_recurring_lines(df).collect()}
    gone = _brute(TEXTS)
    assert len(out) == len(TEXTS) and sum(map(len, gone.values())) > 30
    for i, t in enumerate(TEXTS):
        lines = [] if t is None else t.split("\n")
        assert out[i]["_line_gone"] == sorted(gone.get(t, [])) and out[i]["_line_count"] == len(lines)
        assert out[i]["text"] == (None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone.get(t, [])))


def test_shuffled_leaves(spark, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_ROWS", 0)
    test_as_brute_force(spark)


def test_empty_table(spark):
    assert L.drop_recurring_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _dropped(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["_line_gone"] for r in L.drop_recurring_lines(df).collect()}


def test_long_passages_and_very_frequent_short_lines(spark):
    """A passage of 55 words recurs from 2 documents on, a line of 2 words in very many, one without letters never."""
    passage = " ".join(f"p{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(55))
    short = " ".join(passage.split()[:10])
    texts = [f"Own words {'q' * (i + 1)}\nRead more\n--\n" + ("Seldom seen" if i < 50 else "") + (f"\n{passage}\n{short}" if i < 3 else "") for i in range(L.SHORT_DOCS)]
    got = _dropped(spark, texts)
    gone = Counter(no for nos in got.values() for no in nos)
    assert gone == {1: L.SHORT_DOCS - 1, 4: 2}


def test_rows_of_values_stay(spark):
    """Rows whose tokens are all or mostly values are told apart by them; equal ones and worded ones recur."""
    texts = [f"12{i} 34{i} 56{i}\nhttp://a/{i} http://b/{i} http://c/{i} links\n1 2 3 4\nPosted at noon by user{i}" for i in range(8)]
    gone = Counter(no for nos in _dropped(spark, texts).values() for no in nos)
    assert gone == {2: 7, 3: 7}


def _family(words, name):
    return [w.replace("NAME", f"{name}{'abcdefghij'[i]}") for i, w in enumerate([words] * 10)]


def test_two_families_in_a_leaf(spark):
    """Families of one length that begin alike are told apart; each keeps one line."""
    a = _family("Dear reader named NAME welcome to our little site", "x")
    b = _family("Dear reader named NAME you have won a prize", "y")
    texts = [f"own {'q' * (i + 1)} words\n{x}\n{y}" for i, (x, y) in enumerate(zip(a, b, strict=True))]
    gone = Counter(no for nos in _dropped(spark, texts).values() for no in nos)
    assert gone == {1: 9, 2: 9}


def test_a_family_among_many_other_lines(spark):
    """Ordinary lines that begin alike do not hide a family, however many they are, and stay."""
    vocab = ["red", "blue", "tall", "wide", "old", "new", "odd", "big", "wet", "dry"]
    other = [f"Dear reader named {vocab[i % 10]} {vocab[i // 10 % 10]} {vocab[i // 100 % 10]} {vocab[(i * 7 + i // 10) % 10]} {vocab[(i * 3 + i // 7) % 10]} {vocab[i // 3 % 10]}" for i in range(400)]
    family = _family("Dear reader named NAME welcome to our little site", "x")
    texts = other[:200] + family + other[200:]
    got = _dropped(spark, texts)
    assert sum(bool(v) for k, v in got.items() if 200 <= k < 210) == 9
    gone = _brute(texts)
    assert {i for i, v in got.items() if v} == {i for i, t in enumerate(texts) if gone.get(t)}


def test_real_documents(spark, sf):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    gone = _brute(texts)
    assert _dropped(spark, texts) == {i: sorted(gone.get(t, [])) for i, t in enumerate(texts)}
