"""The ten operators as queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithospark.llm.decontaminate import decontaminate
from lithospark.llm.feistel_shards import feistel_shards
from lithospark.llm.html_extract import extract_main_text
from lithospark.llm.jaccard_join import jaccard_components, jaccard_links
from lithospark.llm.oracle import SQL
from lithospark.llm.packing import pack, word_lengths
from lithospark.llm.quality import fit_quality, score_quality
from lithospark.llm.quotes import link_quotes
from lithospark.llm.substring_dedup import substring_dedup
from lithospark.llm.token_counts import token_counts
from lithospark.llm.vamana import nearest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(table(spark, sf_dir, "documents").select("doc_id", "text"))


def held_out(key: str = "doc_id") -> Column:
    """The fold that no model learns from; a null key belongs to none."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), held_out())
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(word_lengths(table(spark, sf_dir, "documents").select("doc_id", "text")), buckets=8, budget=16_384)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digest = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.encode("text", "utf-8"), F.lit(b""))).alias("text_crc32"),
    )
    dealt = feistel_shards(digest, shards=8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_no", "position")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stripped = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), window=20)
    return stripped.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 20 == 0, neighbours=20)


def op8_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts(docs, public_tokenizers.path(tokenizer))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), window=13)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", F.col("main_text").alias("text"), "n_chars")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op1_ngram_jaccard_links": op1_ngram_jaccard_links,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_quotation_linking": op3_quotation_linking,
        "op4_packing": op4_packing,
        "op5_sharding": op5_sharding,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_nearest_neighbours": op7_nearest_neighbours,
        "op8_token_counts": op8_token_counts,
        "op9_decontamination": op9_decontamination,
        "op10_html_extraction": op10_html_extraction,
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
