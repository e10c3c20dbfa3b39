"""Keyword, vector and hybrid retrieval, and packing of what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.functions import fixed as K
from lodestone.functions.text import keywords


def squared_l2(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


METRICS = {"l2": squared_l2, "cosine": cosine_distance}


def vector_top_k(vectors: DataFrame, query: list[float], *, k: int = K.TOP_K, most: float = K.MAX_DISTANCE, metric: str = "l2", vec: str = "vector", tie: str = "seq") -> DataFrame:
    """The k nearest rows under the distance bound, with distance. One vector is asked for, so it is a literal.

    Each task keeps its own k best (TakeOrderedAndProject); nothing is shuffled.
    """
    q = F.array(*(F.lit(float(x)) for x in query))
    d = vectors.withColumn("distance", METRICS[metric](F.col(vec), q))
    return d.where(F.col("distance") < most).orderBy("distance", tie).limit(k)


def keyword_top(entities: DataFrame, query: str, *, n: int = K.TOP_K, project: str | None = None, name: str = "name", tie: str = "seq", words: list[str] | None = None) -> DataFrame:
    """The first n entities whose name holds a keyword of query: by keyword order, then by seq; with keyword_pos.

    ASCII case does not count. A query without keywords finds nothing.
    """
    if words is None:
        row = entities.sparkSession.range(1).select(keywords(F.lit(query)).alias("k")).first()
        words = row["k"] if row else []
    e = entities.where(F.col("project_id") == project) if project is not None else entities
    pos = F.lit(None).cast("int")
    for i in reversed(range(len(words))):
        pos = F.when(F.contains(F.lower(name), F.lit(words[i].lower())), i).otherwise(pos)
    return e.withColumn("keyword_pos", pos).where("keyword_pos IS NOT NULL").orderBy("keyword_pos", tie).limit(n)


def rrf(ranked: DataFrame, *, k: int = K.RRF_K) -> DataFrame:
    """ranked(list_no, rank, item) -> (item, score, place): reciprocal rank fusion, ties to what was seen first."""
    g = ranked.groupBy("item").agg(
        F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("list_no", "rank"))), lambda x: 1.0 / (k + x["rank"])), F.lit(0.0), lambda s, x: s + x).alias("score"),
        F.min(F.struct("list_no", "rank")).alias("_first"),
    )
    # Bounded by the lists' lengths, which are top-k results.
    return g.withColumn("place", F.row_number().over(W.orderBy(F.desc("score"), "_first"))).drop("_first")


def hybrid(entities: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], *, most: int = K.TOP_K, words: list[str] | None = None) -> DataFrame:
    """Entities by fused rank of vector and keyword search, filled up with keyword hits: entity columns, score, place.

    The two lists meet by `file:start_line`; vector hits that are no entity are dropped.
    """
    key = F.concat_ws(":", "file_path", F.col("start_line").cast("string"))
    order = W.orderBy("distance", "seq")
    v = vector_top_k(vectors, query_vector, k=most).withColumn("rank", F.row_number().over(order) - 1)
    hits = keyword_top(entities, query, n=most, words=words).withColumn("rank", F.row_number().over(W.orderBy("keyword_pos", "seq")) - 1).withColumn("item", key)
    ranked = v.select(F.lit(0).alias("list_no"), "rank", key.alias("item")).unionByName(hits.select(F.lit(1).alias("list_no"), "rank", "item"))
    last = hits.groupBy("item").agg(F.max_by(F.struct(*entities.columns), "rank").alias("e"), F.min("rank").alias("rank"))
    fused = rrf(ranked).join(last.drop("rank"), "item").select("e.*", "score", "place")
    rest = hits.join(fused.select("id"), "id", "left_anti").select(*entities.columns, F.lit(None).cast("double").alias("score"), (F.col("rank") + 1_000_000).alias("place"))
    out = fused.unionByName(rest).withColumn("place", F.row_number().over(W.orderBy("place")))
    return out.where(F.col("place") <= most)


def sections_with(sections: DataFrame, words: list[str]) -> DataFrame:
    """Sections whose content holds any keyword, in the fixed order of sections."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower("content"), F.lit(w.lower()))
    order = F.array_position(F.array(*map(F.lit, K.SECTION_TITLES)), F.col("section_name"))
    return sections.where(hit).withColumn("place", order).where("place > 0")


def pack(items: DataFrame, group: str, *, budget: int = K.CONTEXT_CHARS) -> DataFrame:
    """items(group, part, place, head, body) -> (group, text), packed into about budget characters.

    Parts: 0 semantic matches and 1 entities, which stop at the first block (head and body)
    over what is left; 2 sections, which are cut to fit, after which the packing ends.
    Titles of parts are not charged.
    """
    g = items.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("part", "place", "head", "body"))).alias("s"))
    n = lambda c: F.char_length(c)
    zero = F.struct(F.lit(budget).alias("left"), F.array().cast("array<int>").alias("closed"), F.array().cast("array<int>").alias("open"), F.lit("").alias("text"))
    titles = F.array(F.lit("## Semantic Matches\n"), F.lit("\n## Code Entities\n"), F.lit("\n## Documentation Sections\n"))

    def step(a: Column, x: Column) -> Column:
        part = x["part"].cast("int")
        title = F.when(F.array_contains(a["open"], part), "").otherwise(F.element_at(titles, part + 1))
        is_open = ~F.array_contains(a["closed"], part)
        block = F.concat(x["head"], x["body"])
        fits = n(block) <= a["left"]
        over = (n(x["body"]) + n(x["head"])) > a["left"]
        body = F.when(over, F.concat(F.substring(x["body"], F.lit(1), F.greatest(F.lit(0), a["left"] - n(x["head"]) - 4)), F.lit("\n..."))).otherwise(x["body"])
        cut_left = a["left"] - n(x["head"]) - n(body) - 1
        text = (
            F.when(~is_open, a["text"])
            .when(part == 2, F.concat(a["text"], title, x["head"], body, F.lit("\n")))
            .when(fits, F.concat(a["text"], title, block))
            .otherwise(F.concat(a["text"], title))
        )
        left = F.when(is_open & (part == 2), cut_left).when(is_open & fits, a["left"] - n(block)).otherwise(a["left"])
        stop = is_open & F.when(part == 2, cut_left <= 0).otherwise(~fits)
        closed = F.when(stop, F.concat(a["closed"], F.array(part))).otherwise(a["closed"])
        return F.struct(left.cast("int").alias("left"), closed.alias("closed"), F.array_union(a["open"], F.array(part)).alias("open"), text.alias("text"))

    return g.select(group, F.aggregate("s", zero, step, lambda a: a["text"]).alias("text"))
