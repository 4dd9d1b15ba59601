"""Registered queries of the operators: name -> (Spark callable, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontamination, html_text, lexical, line_dedup, packing, quality, secrets, sharding, simhash, spelling, substring_dedup, toxicity
from .common import documents


def op1_collision_counting_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.nearest(v, lambda id: id % 50 == 0, k=5)


def op2_sampled_splitter_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sharding.shard(documents(spark, sf_dir), shards=40)
    return s.select(F.col("doc").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"))


def op3_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontamination.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10)
    return d.select(F.col("doc").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = simhash.near_duplicates(documents(spark, sf_dir), shingle=4, t=4)
    return n.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op5_recurrent_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("doc", "page_id")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(documents(spark, sf_dir)).withColumnRenamed("doc", "doc_id")


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    model = toxicity.train(d, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(d, model).withColumnsRenamed({"doc": "doc_id", "rejected": "toxic"})


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = substring_dedup.dedup_substrings(documents(spark, sf_dir), n=20, digest=True)
    return d.select(F.col("doc").alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.dedup_lines(documents(spark, sf_dir), min_docs=10, min_key=1)
    return d.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op10_column_generation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packing.pack(documents(spark, sf_dir), limit=1024)
    return p.select(F.col("doc").alias("doc_id"), "start", "length", F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), "sequence_id", "offset")


def op11_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


def op12_partenum_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.groups(spelling.vocabulary(documents(spark, sf_dir), min_len=6, min_count=5, drop_every=199), ratio=5)


def op13_target_ratio_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    return quality.judge(d, quality.train(d, trusted)).withColumnRenamed("doc", "doc_id")


QUERIES = {
    "op1_collision_counting_ann": (op1_collision_counting_ann, None),
    "op2_sampled_splitter_shards": (op2_sampled_splitter_shards, None),
    "op3_prefix_decontamination": (op3_prefix_decontamination, decontamination.SQL),
    "op4_simhash_pigeonring": (op4_simhash_pigeonring, None),
    "op5_recurrent_html_text": (op5_recurrent_html_text, None),
    "op6_secret_scan": (op6_secret_scan, None),
    "op7_toxicity_chain": (op7_toxicity_chain, None),
    "op8_substring_dedup": (op8_substring_dedup, substring_dedup.SQL),
    "op9_line_dedup": (op9_line_dedup, line_dedup.SQL),
    "op10_column_generation_packing": (op10_column_generation_packing, None),
    "op11_block_max_search": (op11_block_max_search, lexical.SQL),
    "op12_partenum_spelling": (op12_partenum_spelling, None),
    "op13_target_ratio_quality": (op13_target_ratio_quality, quality.SQL),
}
