import itertools
import re
from collections import Counter

from pyspark.sql import functions as F

from lodestone.llm import url_filter
from lodestone.llm.queries import URL_RULES, op2_url_filter
from lodestone.llm.url_filter import judge, mine, tokens

RULES = [(a, h, p) for a, h, p in URL_RULES]


def _parts(u):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def _stated(h, p):
    fit = [(len(rh + rp), rh + rp, a) for a, rh, rp in RULES if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
    return max(fit)[1:] if fit else (None, None)


URLS = [None, "", "no scheme", "://", "http://Example.ORG/es/1", "http://a.example.org/en/12", "https://example.org", "http://x.org/en/2?q#f", "http://COM/fr/",
        "http://a.com/de/9?x=http://b.org/", "ftp://notcom/fr/", "http://a.com#/de/", "http://é.Org/\n/x", "http://x.org:80/", "a://b.com/de/?" + "k=1&" * 3000]


def test_stated_rules(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] * 2, "page_id long, url string, rule string")
    df = df.withColumn("_url_host", F.lit("clash")).withColumn("a.b", F.lit(1))
    none = spark.createDataFrame([], url_filter.RULES)
    out = judge(df, none, RULES).collect()
    assert len(out) == 2 * len(URLS)
    for r in out:
        h, p = _parts(URLS[r["page_id"]])
        rule, action = _stated(h, p)
        assert (r["_url_host"], r["_url_path"], r["_url_rule"], r["_url_verdict"]) == (h, p, rule, action or "allow")


def _expanded(learned):
    """Every choice of a token for each item."""
    return {tuple(sorted(c)) for r in learned.collect() for c in itertools.product(*r["antecedent"])}


def test_learned_rules_as_brute_force(spark):
    urls = [(f"http://{'bad' if i % 3 == 0 else 'good'}.example.net/{'a' if i % 2 else 'b'}/{i}?k{i % 2}=1", i % 3 == 0 and (i % 2 == 1 or i % 5 == 0)) for i in range(240)]
    df = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(urls)], "page_id long, url string, bad boolean")
    rows = df.select("page_id", "url", tokens(F.col("url")).alias("tokens"), "bad").collect()
    count, bad = Counter(), Counter()
    for r in rows:
        for k in range(1, len(r["tokens"]) + 1):
            for c in itertools.combinations(r["tokens"], k):
                count[c] += 1
                bad[c] += r["bad"]
    need = max(0.005 * len(rows), 8)
    good = {c: bad[c] / count[c] for c in count if bad[c] >= need and bad[c] / count[c] >= 0.8}
    kept = {c for c in good if not any(good.get(c[:i] + c[i + 1 :], 0) >= good[c] for i in range(len(c)))}
    learned = mine(df.select(tokens(F.col("url")).alias("tokens"), "bad"))
    assert _expanded(learned) == kept and kept
    for r in judge(df, learned, []).collect():
        mine_ = set(rows[r["page_id"]]["tokens"])
        assert (r["_url_verdict"] == "block") == any(set(c) <= mine_ for c in kept)


def test_query_and_empty_tables(spark, sf, tmp_path):
    out = op2_url_filter(spark, sf)
    assert out.count() == spark.read.parquet(f"{sf}/pages.parquet").count()
    for t in ("pages", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert op2_url_filter(spark, str(tmp_path)).count() == 0


def test_long_repeated_urls_are_mined_in_bounded_time(spark):
    """A bad url of 40 tokens that repeats has 2^40 combinations, of which one item stands for all."""
    long = "http://a.b.c.bad.example/" + "/".join(f"s{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(34))
    urls = [(long, True)] * 20 + [(f"http://x.org/p{chr(97 + i)}", False) for i in range(26)] + [(long[: 25 + 3 * i], i % 2 == 0) for i in range(24)]
    df = spark.createDataFrame(urls, "url string, bad boolean")
    learned = mine(df.select(tokens(F.col("url")).alias("tokens"), "bad"))
    rules = learned.collect()
    assert rules and max(len(r["antecedent"]) for r in rules) <= url_filter.MAX_ITEMS
    got = {r["url"]: r["_url_verdict"] for r in judge(spark.createDataFrame([(long,), ("http://x.org/pa",)], "url string"), learned, []).collect()}
    assert got == {long: "block", "http://x.org/pa": "allow"}


def test_rare_pure_hosts_are_learnt_on_large_tables(spark):
    urls = [(f"http://rare.bad/{i}", True) for i in range(8)] + [(f"http://h{i % 50}.org/{i}", i % 50 < 10 and i % 2 == 0) for i in range(20_000)]
    df = spark.createDataFrame(urls, "url string, bad boolean")
    rules = mine(df.select(tokens(F.col("url")).alias("tokens"), "bad")).collect()
    assert any("host=rare.bad" in item for r in rules for item in r["antecedent"])


def test_shuffled_verdicts(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_SETS", -1)
    test_learned_rules_as_brute_force(spark)


def test_long_transactions_lose_no_rule(spark):
    """Every rule of brute force, however few items FP-growth takes of a transaction."""
    spots = [[f"key={chr(97 + k)}" for k in range(9) if (i * 2654435761 >> (k + 8)) % 3] for i in range(300)]
    rows = [(["scheme=http", *t], len({"key=a", "key=c"} & set(t)) == 2 or len({"key=g", "key=h", "key=i"} & set(t)) == 3) for t in spots]
    count, bad = Counter(), Counter()
    for t, b in rows:
        for k in range(1, len(t) + 1):
            for c in itertools.combinations(sorted(t), k):
                count[c] += 1
                bad[c] += b
    good = {c: bad[c] / count[c] for c in count if bad[c] >= 8 and bad[c] / count[c] >= 0.8}
    kept = {c for c in good if not any(good.get(c[:i] + c[i + 1 :], 0) >= good[c] for i in range(len(c)))}
    df = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    assert ("key=a", "key=c") in kept and max(map(len, kept)) >= 3
    for most in (1, 3, 6, 12):
        assert _expanded(mine(df, max_items=most)) == kept
