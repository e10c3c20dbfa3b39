"""A stored substring index over names: many keyword queries at once, without reading the names.

Names are lower-cased (A-Z) and cut into all runs of one to three characters. The index has two tables:
postings(bucket, gram, id), in folders by a hash of the gram and sorted by it, and grams(gram, n), how many names
hold each. A word is looked up by the rarest of its runs of three characters (shorter words by
themselves): those postings are its candidates, whatever the number of names, and every candidate is
verified on its name. A word with a run that no name has finds nothing. Words are found in names literally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.functions import fixed as K

LENGTH = 3
BUCKETS = 64


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _runs(text: Column, size: Column | int) -> Column:
    """The distinct runs of so many characters."""
    size = F.lit(size) if isinstance(size, int) else size
    n = F.char_length(text) - size + 1
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, size)))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def build(entities: DataFrame, path: str, *, id_col: str = "id", name_col: str = "name", keep: list[str] | None = None) -> None:
    """Write the index of entities to a folder; keep names further columns that a search returns."""
    e = entities.where(F.col(name_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(name_col).alias("name"), *(keep or []))
    e.write.mode("overwrite").parquet(f"{path}/names")
    n = _lower(F.col("name"))
    runs = F.flatten(F.array(*(F.when(F.char_length(n) >= k, _runs(n, k)).otherwise(F.array().cast("array<string>")) for k in range(1, LENGTH + 1))))
    spark = entities.sparkSession
    posted = spark.read.parquet(f"{path}/names").select("id", F.explode(runs).alias("gram")).withColumn("bucket", _bucket(F.col("gram")))
    # A frequent run's postings are dealt by id too, so that none is one task's.
    dealt = posted.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8)))
    dealt.sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    posted.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/grams")


def search(spark: SparkSession, path: str, queries: DataFrame, *, n: int = K.TOP_K, tie: str = "id") -> DataFrame:
    """queries(query, pos, word) -> the first n names of each query with keyword_pos: by the place of the word, then by tie."""
    words = queries.where("word <> ''").select("query", "pos", _lower(F.col("word")).alias("word"))
    runs = words.select("word").distinct().select("word", F.explode(_runs(F.col("word"), F.least(F.char_length("word"), F.lit(LENGTH)))).alias("gram"))
    known = runs.join(spark.read.parquet(f"{path}/grams"), "gram", "left")
    best = known.groupBy("word").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.bool_and(F.col("n").isNotNull()).alias("all")).where("all").drop("all")
    # The folder is part of the key, so only those of the words' runs are read.
    posted = spark.read.parquet(f"{path}/postings")
    wanted = best.withColumn("bucket", _bucket(F.col("gram")))
    found = posted.join(wanted, ["bucket", "gram"]).select("word", "id")
    names = spark.read.parquet(f"{path}/names")
    hits = found.join(names, "id").where(F.contains(_lower(F.col("name")), F.col("word")))
    # Each word gives its own first n at most, before words meet their queries.
    first = hits.withColumn("_r", F.row_number().over(W.partitionBy("word").orderBy(tie, "id"))).where(F.col("_r") <= n * (_most_words(words))).drop("_r")
    each = words.groupBy("query", "word").agg(F.min("pos").alias("keyword_pos")).join(first, "word").drop("word")
    least = each.groupBy("query", "id").agg(F.min_by(F.struct("keyword_pos", *(c for c in names.columns if c != "id")), "keyword_pos").alias("e")).select("query", "id", "e.*")
    return least.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("keyword_pos", tie, "id"))).where(F.col("rank") <= n)


def _most_words(words: DataFrame) -> int:
    """The largest number of words of a query: what a word finds may go to earlier ones of its query."""
    return words.groupBy("query").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
