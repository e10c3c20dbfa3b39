"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts that are equal after lower-casing A-Z; the largest doc_id stays."""
    from lodestone.llm.exact_dedup import exact_dedup

    return exact_dedup(spark, f"{sf_dir}/documents.parquet").select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        "kept",
        F.col("digest").alias("text_sha256"),
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: sizes, targets and the words taken of each."""
    from lodestone.llm.mixing import mix

    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id",
        F.col("_mix_size").alias("size"),
        F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"),
        (F.col("_mix_size") * F.col("_mix_copies")).alias("taken"),
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation's turns and trained text, read back from the formatted output."""
    from lodestone.llm.chat import format_chats, read_back, text_part

    hard = "\\### Assistant: </turn> ok"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(hard).alias("text"),
    )
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(own.columns).unionByName(own)
    chunks = read_back(format_chats(turns.withColumn("parts", text_part(F.col("text")))))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    part = F.struct("piece", "chunk", F.array_join(said, "").alias("said"), "loss")
    whole = chunks.groupBy("conv").agg(
        F.sum(F.size("turns").cast("long")).alias("n_turns"),
        F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(part)).alias("parts"),
    )
    loss = F.array_join(F.transform("parts", lambda p: p["loss"]), "")
    return whole.select(
        F.col("conv").alias("conv_id"),
        "n_turns",
        F.sha2(F.array_join(F.transform("parts", lambda p: p["said"]), ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and of the bytes they decode to."""
    import public_tokenizers

    from lodestone.llm.bpe import Codec, encode

    codec = Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), codec)


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of every vector whose id is divisible by 20."""
    from lodestone.llm.topk import top_k

    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


#: Stated rules: (action, host, path).
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url; pages are labelled by the label of the same id, bad if toxic or of quality 0."""
    from lodestone.llm.url_filter import judge, mine, tokens

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy(F.col("doc_id").alias("page_id")).agg(
        F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad")
    )
    labelled = pages.join(labels.where("bad IS NOT NULL"), "page_id").select(tokens(F.col("url")).alias("tokens"), "bad")
    return judge(pages, mine(labelled), URL_RULES).select(
        "page_id",
        F.col("_url_host").alias("host"),
        F.col("_url_path").alias("path"),
        F.col("_url_rule").alias("rule"),
        F.col("_url_verdict").alias("verdict"),
        F.col("_url_confidence").alias("confidence"),
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents that are not held out."""
    from lodestone.llm.language import held_out, predict, train

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = held_out(F.col("doc_id"))
    model = train(docs.where(~out))
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id",
        out.alias("held_out"),
        F.col("_lid_lang").alias("lang_pred"),
        F.col("_lid_score").alias("score"),
        F.col("_lid_rejected").alias("rejected"),
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's set of 3-word shingles and its component under Jaccard >= 0.9."""
    from lodestone.llm.jaccard import jaccard_components

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs).select(
        "doc_id", F.col("_jac_n").alias("n_shingles"), F.col("_jac_component").alias("component_id")
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its recurring lines."""
    from lodestone.llm.line_dedup import drop_recurring_lines

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_recurring_lines(docs).select(
        "doc_id",
        F.col("_line_count").cast("long").alias("n_lines"),
        F.size("_line_gone").cast("long").alias("n_dropped"),
        "text",
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own and inherited licence of every document, taken as the file /source/lang/doc_id without the parts that are null."""
    from lodestone.llm.license import scan

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", F.lit(""), F.col("source"), F.col("lang"), F.col("doc_id").cast("string"))
    return scan(docs.select("doc_id", path.alias("path"), "text")).select(
        "doc_id",
        "path",
        F.col("_lic_own").alias("own_licence"),
        F.col("_lic_score").alias("score"),
        F.col("_lic_line").alias("line"),
        F.col("_lic_is_file").alias("is_licence_file"),
        F.col("_lic_from").alias("inherited_from"),
        F.col("_lic_licence").alias("licence"),
    )


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document, with sizes near equal."""
    from lodestone.llm.sharding import shard

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs).select(
        "doc_id",
        F.col("_shard_size").alias("size"),
        F.col("_shard_crc32").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard_id").alias("shard"),
        F.col("_shard_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weights of all documents towards the benchmark's n-grams, and the quarter that is drawn."""
    from lodestone.llm.resample import resample

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(
        "doc_id",
        F.col("_res_n").alias("n_features"),
        F.col("_res_weight").alias("weight"),
        F.col("_res_score").alias("score"),
        F.col("_res_rank").alias("rank"),
    )


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged for filling in its middle, with digests of the output and of the text restored from it."""
    from lodestone.llm.infill import fill_in_middle, restore

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return fill_in_middle(docs).select(
        "doc_id",
        F.col("_fim_units").alias("n"),
        F.col("_fim_form").alias("form"),
        F.col("_fim_prefix_chars").alias("prefix_chars"),
        F.col("_fim_middle_chars").alias("middle_chars"),
        F.sha2(F.col("_fim_output"), 256).alias("output_sha256"),
        F.sha2(restore(F.col("_fim_output"), F.col("_fim_form")), 256).alias("restored_sha256"),
    )
