"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import language_id, oracles, quality
from flowlens.llm.bpe import decode, encode
from flowlens.llm.decontamination import find_passages
from flowlens.llm.embedding_dedup import near_duplicate_vectors
from flowlens.llm.hard_negatives import mine
from flowlens.llm.html_extract import main_text
from flowlens.llm.minhash_dedup import near_duplicates
from flowlens.llm.packing import pack
from flowlens.llm.substring_dedup import remove_repeated_words
from flowlens.llm.suffix_dedup import remove_repeated_bytes
from flowlens.llm.token_counts import token_counts
from flowlens.llm.vector_codes import codebook_digest, compress, with_label_error


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.apply_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select("doc_id", *[F.col(f"quality_{c}").alias(c) for c in counts])


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id.identify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_words(docs).select(
        "doc_id", F.col("dedup_n_units").alias("n_words"), F.col("dedup_n_removed").alias("n_removed"), F.sha2("dedup_kept", 256).alias("kept_sha256")
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = decode(encode(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "token_ids"))
    return coded.select(
        "doc_id", (F.octet_length("token_ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4, percent=80)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_bytes(docs).select(
        "doc_id", F.col("dedup_n_units").alias("n_bytes"), F.col("dedup_n_removed").alias("n_removed"),
        F.size("dedup_removed").cast("bigint").alias("n_spans"), F.sha2("dedup_kept", 256).alias("kept_sha256"),
    )


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("item_id", "text"), keep=["doc_id"])
    n_hit = F.aggregate("leak_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", F.col("leak_n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("leak_items").cast("bigint").alias("n_items"), F.sha2(F.array_join("leak_items", ","), 256).alias("items_sha256"),
        (F.size("leak_spans") > 0).alias("contaminated"),
    )


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    digests = [x for size, book in books.items() for x in (F.lit(size), F.lit(codebook_digest(book, size)))]
    digest = F.element_at(F.create_map(*digests), F.col("size")) if digests else F.lit(None).cast("string")
    return with_label_error(coded).select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_html_extract": op3_html_extract,
    "op4_quality_rules": op4_quality_rules,
    "op6_language_id": op6_language_id,
    "op5_substring_dedup": op5_substring_dedup,
    "op7_bpe": op7_bpe,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_packing": op10_packing,
    "op11_decontamination": op11_decontamination,
    "op12_vector_codes": op12_vector_codes,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_dedup": oracles.EMBEDDING_DEDUP,
    "op4_quality_rules": quality.ORACLE_SQL,
    "op5_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op8_minhash_dedup": oracles.MINHASH_DEDUP,
    "op9_suffix_dedup": oracles.SUFFIX_DEDUP,
    "op11_decontamination": oracles.DECONTAMINATION,
    "op12_vector_codes": oracles.VECTOR_CODES,
    "op13_hard_negatives": oracles.HARD_NEGATIVES,
}
