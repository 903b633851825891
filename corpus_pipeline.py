"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, source mix, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import contamination, mixing, near_dups, quality, token_files
from tallyline.llm.cluster import fresh_dir, fresh_names, small_batches
from tallyline.llm.queries import tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules and the isolation forest keep."""
    small_batches(spark)
    forest = quality.fit_forest(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, forest)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group linked by five-word shingles at 0.8 or more."""
    small_batches(spark)
    (gone,) = fresh_names(docs, "gone")
    found = near_dups.near_duplicates(docs, shingle_words=5)
    dropped = found.where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(dropped, docs["doc_id"] == F.col(gone), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    small_batches(spark)
    return contamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    small_batches(spark)
    return mixing.take_mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, written as token files; one row per text, read back from them."""
    small_batches(spark)
    path = fresh_dir(spark, "tokens")
    manifest = token_files.write_token_files(docs, path, tokenizer_file())
    return token_files.read_token_digests(manifest, path)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_output", token_output),
]
#: The forest, the balanced sample and the tokenizer are beyond SQL; tests hold the operators of the stages against plain versions, where README says so.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = fresh_dir(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
