"""Token counts: an exact histogram of encoded lengths whose suffix sums answer every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_bpe import encoder
from .cluster import cut, running_sums


def _count(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(len(batch), np.int64)
            for lo, hi, _, offs in encoder(tokenizer).encode(batch.column(batch.num_columns - 1), counts_only=True):
                out[lo:hi] = np.diff(offs)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], [*batch.schema.names[:-1], "length"])

    return run


def encoded_lengths(docs: DataFrame, tokenizer: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and `length`, the number of ids of the whole text; null counts as empty."""
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_count(tokenizer), f"{kept}, length long" if kept else "length long")


def length_histogram(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """One row per encoded length that occurs: length, n_docs, n_tokens, longer_docs, longer_tokens (texts of more ids),
    at_most_docs, truncated_tokens (ids left if every text is cut to `length`).

    Texts meet only as partial counts per length. Suffix sums over the lengths run through range partitions, so no task
    sees them all. Defined cases: null and empty texts have length 0; an empty table gives an empty result; repeated
    rows count each; extra columns are ignored.
    """
    lengths = encoded_lengths(docs, tokenizer, text_col, keep=())
    counts = cut(lengths.groupBy("length").agg(F.count("*").alias("n_docs")))
    own = counts.withColumn("n_tokens", F.col("length") * F.col("n_docs"))
    out = running_sums(own, [F.col("length").desc()], {"longer_docs": F.col("n_docs"), "longer_tokens": F.col("n_tokens")})
    total = own.agg(F.sum("n_docs").alias("_d"), F.sum("n_tokens").alias("_t"))
    out = out.join(F.broadcast(total))  # a single row
    return out.select("length", "n_docs", "n_tokens", "longer_docs", "longer_tokens", (F.col("_d") - F.col("longer_docs")).alias("at_most_docs"), (F.col("_t") - F.col("longer_tokens") + F.col("length") * F.col("longer_docs")).alias("truncated_tokens"))


def tokens_within(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Exact (limit, tokens left, documents cut) for any context limits, from the histogram alone. An empty
    histogram or no limits give no rows; a repeated limit gives one row; a limit must not be null."""
    asked = histogram.sparkSession.createDataFrame([(int(x),) for x in dict.fromkeys(limits)], "context_limit long")
    # the limits are the caller's list, so a bounded table
    kept = F.when(F.col("length") <= F.col("context_limit"), F.col("n_tokens")).otherwise(F.col("context_limit") * F.col("n_docs"))
    over = F.when(F.col("length") > F.col("context_limit"), F.col("n_docs")).otherwise(0)
    return histogram.join(F.broadcast(asked)).groupBy("context_limit").agg(F.sum(kept).alias("tokens"), F.sum(over).alias("cut_docs"))


def length_quantile(histogram: DataFrame, q: float) -> Column | int | None:
    """The least length that at least the share q of all documents do not exceed; None for an empty histogram."""
    total = F.lit(histogram.agg(F.sum("n_docs")).first()[0] or 0)
    return histogram.where(F.col("at_most_docs") >= F.ceil(total * F.lit(q))).agg(F.min("length")).first()[0]
