"""URL filters by rules and by association rules [native].

Method: labelled urls become transactions of tokens (scheme, host suffixes, path segments
with digits masked, query keys) plus the item of the bad class; Spark's FP-growth mines the
combinations. Tokens that occur in the same urls only, such as the parts of one host or of one
repeated url, are one item, as any of them stands for all: else a url of n tokens would have
2^n combinations. Items in too few bad urls are left out, as no rule can hold them. FP-growth
takes the transactions of at most MAX_ITEMS items, which bounds its combinations: it counts every
combination with an item that no longer transaction holds. The other combinations, of items from longer
transactions only, are counted level by level over all transactions. There a combination goes on only if
each item narrows it, as no rule that is kept holds an idle item; so nested items do not multiply.

Rules `items -> bad` are kept above a support and a confidence, and a rule is dropped if one of
its subsets does as well. A single item needs MIN_COUNT bad urls, whatever the table's size, so
that rare hosts stay learnable; a combination needs MIN_SUPPORT of all labelled urls as well.
The rules are matched by an inverted index from token to rule: distinct token sets meet the
index by an equi-join and a rule fires when a token of each of its items was hit. Stated (host,
path) rules go first: of those whose host is the url's or a parent domain and whose path starts
the url's path, the longest wins.

Defined results: null urls and urls without `://` have empty host and path and no tokens, so
they get the method's default, allow; repeated rows each get a verdict; without labels no
rule is mined; an empty table gives no rows; extra columns pass through, but for those whose
name starts with _url_, which are dropped.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text import UPPER, all_of, named, without_reserved
from lodestone.runtime import Scratch

MIN_SUPPORT = 0.005  # share of the labelled urls that a combination and its class must hold
MIN_COUNT = 8  # and at least so many urls, which is all that a single item needs
MIN_CONFIDENCE = 0.8
MAX_ITEMS = 12  # of a transaction for FP-growth; combinations of longer ones are counted level by level
#: Verdicts of at most so many token sets are broadcast; more are joined by a shuffle.
BROADCAST_SETS = 50_000
RULES = "antecedent array<array<string>>, confidence double, support double"
BAD = "class=bad"


def host(url: Column) -> Column:
    h = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(h, UPPER, UPPER.lower())


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def stated_rule(h: Column, p: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, action), or null. rules: (action, host, path)."""
    fits = F.lit(None).cast("struct<rule: string, action: string>")
    for action, rh, rp in sorted(rules, key=lambda r: len(r[1] + r[2])):
        on = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        fits = F.when(on, F.struct(F.lit(rh + rp).alias("rule"), F.lit(action).alias("action"))).otherwise(fits)
    return fits


def tokens(url: Column) -> Column:
    """Sorted distinct tokens of a url."""
    u = F.coalesce(url, F.lit(""))
    labels = F.split(host(url), r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i, F.size(labels)), "."))
    )
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    segments = F.transform(segments, lambda s, i: F.concat(F.lit("path"), i.cast("string"), F.lit("="), F.regexp_replace(s, "[0-9]+", "#")))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.concat(F.lit("key="), F.split(s, "=")[0]))
    scheme = F.array(F.concat(F.lit("scheme="), F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)))
    some = F.when(u.contains("://"), F.concat(scheme, suffixes, segments, keys)).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(some))


def narrowing_sets(held: DataFrame, need: float, scratch: Scratch) -> DataFrame:
    """held(id, bad, name) -> (antecedent, n, b): sets of names in at least need bad ids of which no name is idle.

    A name is idle if the others occur in the same ids without it. Sets grow by one name a level; all parts
    of such a set are such sets, so a level misses none.
    """
    kinds = held.groupBy("id", "bad").agg(F.array_sort(F.collect_set("name")).alias("names"))
    kinds = kinds.groupBy("names").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("b"))
    kinds = scratch.keep(kinds.withColumn("kind", F.monotonically_increasing_id()), "kinds")
    names = kinds.select("kind", F.explode("names").alias("name"))
    held_by = kinds.select("kind", "n", "b", F.explode("names").alias("last")).withColumn("antecedent", F.array("last"))
    found, size = None, 1
    while True:
        level = held_by.groupBy("antecedent").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).where(F.col("b") >= need)
        if found is not None:
            parts = F.transform("antecedent", lambda x: F.filter("antecedent", lambda y: y != x))
            less = before.select(F.col("antecedent").alias("part"), F.col("n").alias("part_n"))
            parts = level.select("antecedent", "n", F.explode(parts).alias("part")).join(less, "part").where("part_n > n")
            level = level.join(parts.groupBy("antecedent").count().where(F.col("count") == size).select("antecedent"), "antecedent")
        before = scratch.keep(level.select("antecedent", "n", "b"), f"sets{size}")
        if before.isEmpty():
            return before if found is None else found
        found = before if found is None else found.unionByName(before)
        grown = held_by.join(before.select("antecedent"), "antecedent").join(names, "kind").where(F.col("name") > F.col("last"))
        held_by = grown.select("kind", "n", "b", F.col("name").alias("last"), F.concat("antecedent", F.array("name")).alias("antecedent"))
        held_by = scratch.keep(held_by, f"held{size}")
        size += 1


def mine(
    labelled: DataFrame, *, min_support=MIN_SUPPORT, min_count=MIN_COUNT, min_confidence=MIN_CONFIDENCE, max_items=MAX_ITEMS
) -> DataFrame:
    """labelled(tokens, bad) -> rules(antecedent, confidence, support), pruned.

    An antecedent is a list of items, an item the tokens of which any one stands for it.
    """
    spark = labelled.sparkSession
    scratch = Scratch(spark, "url-rules")
    base = scratch.keep(labelled.select("tokens", "bad", F.monotonically_increasing_id().alias("id")), "labelled")
    n = base.count()
    if n < min_count:
        return spark.createDataFrame([], RULES)
    words = base.select("id", "bad", F.explode("tokens").alias("token"))
    marks = words.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("b"), F.bit_xor(F.xxhash64("id")).alias("m1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("m2")
    )
    items = marks.where(F.col("b") >= min_count).groupBy("n", "b", "m1", "m2").agg(F.array_sort(F.collect_list("token")).alias("item"))
    items = scratch.keep(items.select("n", "b", "item", F.element_at("item", 1).alias("name"), (F.col("b") / F.col("n")).alias("confidence")), "items")
    single = items.where(F.col("confidence") >= min_confidence).select(F.array("name").alias("antecedent"), "confidence", (F.col("b") / n).alias("support"))

    need = max(min_support, min_count / n)
    often = items.where(F.col("b") >= need * n - 1e-9).select("name", "n", "confidence", F.explode(F.array("name")).alias("token"))
    brought = words.join(often, "token").groupBy("id", "bad").agg(F.array_sort(F.collect_list("name")).alias("names"))
    brought = scratch.keep(brought, "brought")
    long = F.size("names") > max_items
    # All labelled urls count for the support, those without an item and the long ones too.
    items_of = F.when(long, F.array(F.lit("none"))).when(F.col("bad"), F.concat("names", F.array(F.lit(BAD)))).otherwise(F.col("names"))
    missing = base.select("id").join(brought.select("id"), "id", "left_anti").select(F.array(F.lit("none")).alias("items"))
    baskets = scratch.keep(brought.select(items_of.alias("items")).unionByName(missing), "baskets")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, need), minConfidence=min_confidence).fit(baskets)
    more = model.associationRules.where((F.col("consequent") == F.array(F.lit(BAD))) & (F.size("antecedent") > 1)).select(
        F.array_sort("antecedent").alias("antecedent"), "confidence", "support"
    )
    deep = scratch.keep(brought.where(long).select(F.explode("names").alias("name")).distinct(), "deep")
    if not deep.isEmpty():
        token = more.select("antecedent", F.explode("antecedent").alias("name"))
        whole = token.join(deep, "name", "left_anti").select("antecedent").distinct()
        held = brought.select("id", "bad", F.explode("names").alias("name")).join(deep, "name")
        rest = narrowing_sets(held, need * n - 1e-9, scratch).where(F.size("antecedent") > 1).withColumn("confidence", F.col("b") / F.col("n"))
        rest = rest.where(F.col("confidence") >= min_confidence).select("antecedent", "confidence", (F.col("b") / n).alias("support"))
        more = more.join(whole, "antecedent", "left_semi").unionByName(rest)
    rules = scratch.keep(single.unionByName(more), "rules")
    less = rules.select(F.col("antecedent").alias("part"), F.col("confidence").alias("part_confidence"))
    smaller = rules.withColumn("token", F.explode("antecedent")).withColumn(
        "part", F.filter("antecedent", lambda t: t != F.col("token"))
    )
    idle = smaller.join(less, "part").where(F.col("part_confidence") >= F.col("confidence")).select("antecedent").distinct()
    kept = rules.join(idle, "antecedent", "left_anti").withColumn("name", F.explode("antecedent")).join(items.select("name", "item"), "name")
    return kept.groupBy("antecedent", "confidence", "support").agg(F.array_sort(F.collect_list("item")).alias("items")).select(
        F.col("items").alias("antecedent"), "confidence", "support"
    )


def judge(
    pages: DataFrame,
    learned: DataFrame,
    rules: list[tuple[str, str, str]],
    *,
    url_col: str = "url",
) -> DataFrame:
    """pages with _url_host, _url_path, _url_rule, _url_verdict, _url_confidence (of the learned rule that fired)."""
    pages = without_reserved(pages, "_url_")
    fit = stated_rule(F.col("_url_host"), F.col("_url_path"), rules)
    u = named(url_col)
    rows = pages.withColumn("_url_host", host(u)).withColumn("_url_path", path(u)).withColumn("_url_tokens", tokens(u))
    sets = rows.select("_url_tokens").distinct()
    index = learned.select(
        F.xxhash64("antecedent").alias("rule"), F.size("antecedent").alias("size"), "confidence", F.posexplode("antecedent").alias("slot", "item")
    ).select("rule", "size", "confidence", "slot", F.explode("item").alias("token"))
    hits = sets.withColumn("token", F.explode("_url_tokens")).join(index, "token")
    fired = hits.groupBy("_url_tokens", "rule", "size", "confidence").agg(F.size(F.collect_set("slot")).alias("hit")).where(F.col("hit") == F.col("size"))
    fired = fired.groupBy("_url_tokens").agg(F.max("confidence").alias("_url_confidence"))
    fired = Scratch(pages.sparkSession, "url-verdicts").keep(fired, "fired", files=64)
    if fired.count() <= BROADCAST_SETS:
        fired = F.broadcast(fired)
    method = F.when(F.col("_url_confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return (
        rows.join(fired, "_url_tokens", "left")
        .withColumn("_url_fit", fit)
        .withColumn("_url_rule", F.col("_url_fit.rule"))
        .withColumn("_url_verdict", F.coalesce(F.col("_url_fit.action"), method))
        .select(*all_of(pages), "_url_host", "_url_path", "_url_rule", "_url_verdict", "_url_confidence")
    )
