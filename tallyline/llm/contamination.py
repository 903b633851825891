"""Benchmark decontamination: size-partitioned MinHash containment search, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import cut, fresh_names

#: Rows up to which a table of items or candidates is broadcast (some 20 MB); beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: Bins of the sketch per shingle of the largest document in a size partition.
BINS_PER_SHINGLE = 8
#: Items of fewer shingles are looked up among all shingles of a document instead of its sketch.
SHORT_ITEM = 8


def _shingled(df: DataFrame, k: int) -> DataFrame:
    """Add sh, the array of 64-bit shingle hashes (unsorted, with repeats) of lower-cased text; fewer than k words: one
    hash of the whole sequence; no word or null text: empty."""
    words = F.filter(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    df = df.withColumn("_h", F.coalesce(F.transform(words, lambda w: F.xxhash64(w)), F.array().cast("array<bigint>")))
    windows = F.transform(F.sequence(F.lit(0), F.size("_h") - k), lambda i: F.xxhash64(*[F.get("_h", i + j) for j in range(k)]))
    whole = F.array(F.xxhash64(F.col("_h")))
    return df.withColumn("sh", F.when(F.size("_h") >= k, windows).when(F.size("_h") > 0, whole).otherwise(F.array().cast("array<bigint>"))).drop("_h")


def _shift(size: Column) -> Column:
    """Size partition of a set: the number of low bits outside the bin number. Partitions are powers of two of size,
    and each has BINS_PER_SHINGLE bins per shingle of its largest member."""
    return (F.lit(63) - F.ceil(F.log2(F.greatest(size, F.lit(1)) * BINS_PER_SHINGLE))).cast("int")


def _sketch(shift: Column) -> Column:
    """MinHash with one permutation: the least hash in each bin, bins being ranges of the top bits."""
    ordered = F.col("_sorted")
    return F.filter(ordered, lambda x, i: (i == 0) | (F.call_function("shiftright", x, shift) != F.call_function("shiftright", F.get(ordered, i - 1), shift)))


def _small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """Pairs (id, item, item_shingles, shared) where the document holds at least `percent` of the item's shingles.

    Documents are partitioned by set size. Each partition has its own MinHash sketch, with enough bins for its largest
    member that a short item's shingles still stand out in a long text; items are sketched once per partition. A pair
    that agrees in one bin is a candidate and is verified on full shingle sets. A shared shingle is hidden by another of
    the same bin with probability 0.06 at most, so an item of n shingles would be missed with probability 0.06^(0.8 n).
    Items of fewer than SHORT_ITEM shingles are therefore found without the sketch: of n shingles of which m must be
    held, a document that matches holds one of any n - m + 1, and these are joined with all shingles of the documents.

    Defined cases: texts without words have no shingles and match nothing; a text of fewer words than a shingle is one
    shingle and matches texts of the same words. Repeated rows of one id count as one text per row, the best row
    decides. Null ids match nothing. Empty tables give an empty result. Extra columns are ignored, whatever their names.
    """
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).where("_id is not null")
    wanted = items.select(F.col(item_col).alias("_item"), F.col(item_text).cast("string").alias("text")).where("_item is not null")
    wanted = cut(_shingled(wanted, shingle_words).select("_item", F.array_sort(F.array_distinct("sh")).alias("_sorted")))
    shifts = wanted.sparkSession.range(0, 64).select(F.col("id").cast("int").alias("shift"))
    # 64 partitions at most: a size that the word length bounds
    n = F.size("_sorted")
    short = wanted.where((n > 0) & (n < SHORT_ITEM))
    index = wanted.where(n >= SHORT_ITEM).join(F.broadcast(shifts.where((F.col("shift") >= 24) & (F.col("shift") <= 60))), F.lit(True))
    index = index.select("shift", F.explode_outer(_sketch(F.col("shift"))).alias("h"), "_item").where("h is not null").select(F.xxhash64("shift", "h").alias("key"), "_item")
    need = F.ceil(n * F.lit(percent) / 100).cast("int")
    exact = short.select(F.explode(F.slice("_sorted", 1, n - need + 1)).alias("h"), "_item").select(F.xxhash64("h").alias("key"), "_item")
    index = cut(index.union(exact))
    # No filter may refer to the arrays: the optimiser would push it below them and compute them again per element.
    # So explode_outer, which implies none, and a join key that cannot be null.
    sized = _shingled(texts, shingle_words).select("_id", F.array_sort("sh").alias("_sorted"), _shift(F.size("sh")).alias("shift"))
    mins = sized.select("_id", "shift", F.explode_outer(_sketch(F.col("shift"))).alias("h")).select("_id", F.xxhash64("shift", "h").alias("key"))
    if not short.isEmpty():
        mins = mins.union(sized.select("_id", F.explode_outer("_sorted").alias("h")).select("_id", F.xxhash64("h").alias("key")))
    candidates = cut(mins.join(_small(index), "key").select("_id", "_item").distinct())
    again = texts.join(_small(candidates.select("_id").distinct()), "_id", "left_semi")
    again = _shingled(again, shingle_words).join(_small(candidates), "_id").join(_small(wanted), "_item")
    held = again.select("_id", "_item", F.size("_sorted").alias("n"), F.size(F.array_intersect("_sorted", "sh")).alias("both"))
    held = held.where(100 * F.col("both") >= percent * F.col("n")).groupBy("_id", "_item").agg(F.max("n").cast("long").alias("item_shingles"), F.max("both").cast("long").alias("shared"))
    return held.select(F.col("_id").alias(id_col), F.col("_item").alias(item_col), "item_shingles", "shared")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without those in which find_contamination() finds an item; rows with a null id stay."""
    (hit,) = fresh_names(docs, "hit")
    found = cut(find_contamination(docs, items, id_col, text_col, **options).select(F.col(id_col).alias(hit)).distinct())
    return docs.join(_small(found), docs[id_col] == F.col(hit), "left_anti")
