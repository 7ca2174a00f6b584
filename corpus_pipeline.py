"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

1. quality: rejects documents whose calibrated score of label 1 is below 0.7.
2. language: rejects documents of no language, and those whose prediction is ambiguous.
3. near_dedup: of each group of documents linked at a similarity of 0.8 or more of their five-word
   shingles, the one with the least id stays.
4. mixing: repeats or leaves out documents so that each source comes near its target.
5. bpe: encodes each text and decodes it again.

Null and empty texts score like any other text, have no language, and so end at stage 2. Other
columns of documents, whatever their names, pass through to stage 4 unchanged. Rows that repeat an
id are one document for stage 3; rows without an id pass it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from histospark.llm import bpe, langid, minhash, mixing, quality
from histospark.llm.common import fresh_path, n_words, quoted, small_batches, table
from histospark.llm.queries import GOOD, tokenizer_path

SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.quality_score(docs["text"], model, spark) >= GOOD)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = langid.language(docs["text"], langid.fit_languages(docs), spark)
    return docs.where(F.when(found["lang"] != langid.UNKNOWN, ~found["ambiguous"]).otherwise(False))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = minhash.near_duplicates(docs, SHINGLE_WORDS, SIMILAR_PERCENT)
    extra = found.where("not kept").select(F.col("doc_id").alias("_extra")).distinct()
    row = docs.select(F.struct(*map(quoted, docs.columns)).alias("doc"))
    left = row.join(extra, F.col("doc.doc_id") == F.col("_extra"), "left_anti")
    place = F.row_number().over(Window.partitionBy(F.col("doc.doc_id"), F.when(F.col("doc.doc_id").isNull(), F.xxhash64("doc.text"))).orderBy("doc.text"))
    return left.withColumn("place", place).where((F.col("place") == 1) | F.col("doc.doc_id").isNull()).select("doc.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.systematic_mix(docs, n_words(docs["text"]), carry=True, salt=docs["text"])
    return mixed.where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    path = tokenizer_path()
    both = docs.select("doc_id", "source", "lang", bpe.bpe_round_trip(F.col("text"), path).alias("both")).select("doc_id", "source", "lang", "both.*")
    return both.select("doc_id", "source", "lang", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: Trained models, near-duplicate search and merges aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
