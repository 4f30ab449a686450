"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm import alignment, chat, decontam, lines, minhash, mixing, quality, simhash, suffix, tokens, urls, warc, whitening
from provena.llm.common import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_quotes(table(spark, sf_dir, "conversations"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return decontam.judged(docs, items, keep=["doc_id"]).select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        decontam.digest(F.col("_items")).alias("items_sha256"), F.col("_contaminated").alias("contaminated"),
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_substrings(table(spark, sf_dir, "documents"), keep_bytes=False).drop("kept")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed_lines").alias("n_removed_lines"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return tokens.maintained(tokens.Ledger(spark), docs, [f"{tokens.vocabulary_dir()}/{name}" for name in tokens.VOCABULARIES])


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder, compress=True)
    return warc.archived_pages(spark, folder)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = urls.judge_urls(urls.captures_of(pages), urls.entries_of(pages))
    return found.select(
        "page_id", F.date_format("fetched_on", "yyyy-MM-dd").alias("fetched_on"), F.col("_host").alias("host"), F.col("_pattern").alias("pattern"),
        F.col("_action").alias("action"), F.col("_kept").alias("kept"),
    )


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_simhash": op3_simhash,
    "op4_mixing": op4_mixing,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_token_counts": op8_token_counts,
    "op9_warc": op9_warc,
    "op10_url_filters": op10_url_filters,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_minhash": op12_minhash,
    "op13_embedding_whitening": op13_embedding_whitening,
}
ORACLES: dict[str, str] = {
    "op1_quality_rules": quality.ORACLE,
    "op2_chat_formatting": chat.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op7_decontamination": decontam.ORACLE,
    "op6_line_dedup": lines.ORACLE,
    "op9_warc": warc.ORACLE,
    "op10_url_filters": urls.ORACLE,
    "op12_minhash": minhash.ORACLE,
}
