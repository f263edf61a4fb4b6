"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir), reads all that the stage before kept, and returns the
columns of ``documents`` (the last: packing rows). Every stage's decisions take effect. Columns beyond those of
``documents`` are ignored; every stage gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import language_id
from flowlens.llm.lineage import written
from flowlens.llm.minhash_dedup import near_duplicates
from flowlens.llm.packing import pack
from flowlens.llm.quality import apply_rules
from flowlens.llm.repeats import NO_ID
from flowlens.llm.substring_dedup import remove_repeated_words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule. Null and empty texts fail it; repeated rows share one verdict; ids play no part."""
    return apply_rules(docs.select(COLUMNS)).where("quality_kept").select(COLUMNS)


def language_identification(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents written in a language that is known; ``lang`` becomes the predicted one.

    Texts that are null or have no letter go; where no row is labelled nothing can be told, so all documents stay as
    they are. Repeated rows share one prediction; of languages with equally short codes the first by name is taken.
    """
    docs = docs.select(COLUMNS)
    model = language_id.train(docs.where(~language_id.held_out()).where("doc_id IS NOT NULL"))
    if model is None:
        return docs
    out = language_id.classify(docs, model)
    return out.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("lang_score") >= 0.5)).withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (shingles of five words, similarity 0.8): its smallest id.

    Rows of one id and one text are one document. Of several texts under one id, or without an id (ordered
    after all ids), each is a document, and the one whose text has the smallest hash comes first. Null and empty
    texts are near nothing: one row of each id stays.
    """
    marks = near_duplicates(docs.select("doc_id", "text"), hash_col="tag").where("kept")
    known = F.coalesce("doc_id", F.lit(NO_ID)).alias("id")
    rows = docs.select(known, F.xxhash64("text").alias("tag"), *COLUMNS).join(marks.select(known, "tag").distinct(), ["id", "tag"], "left_semi")
    one = rows.groupBy("id", "tag", "text").agg(F.min(F.struct("doc_id", "lang", "source", "n_chars")).alias("d"))
    return one.select("text", "d.*").select(COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without word sequences that an earlier document holds; documents that lose all words go.

    Null and empty texts have no words and go; rows of one id and one text are one document and share its result; rows
    of one id and different texts are ordered by a hash of the text; null ids come last.
    """
    out = remove_repeated_words(docs.select(COLUMNS)).where("dedup_n_units > dedup_n_removed")
    text = F.when(F.col("dedup_n_removed") > 0, F.col("dedup_kept")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens. A null or empty text is its end id alone; repeated rows are documents of their own."""
    return pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_identification),
    ("minhash_dedup", minhash_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: SQL can express neither language identification nor the tokens; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
