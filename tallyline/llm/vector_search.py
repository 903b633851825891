"""Exact top-k search by inner product with a vector-approximation file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .cluster import cut, fresh_dir, hot_join, running_sums
from .vectors import matrix

#: Distinct query vectors of one pass over the file. A pass sends them to all tasks: 8 MB at 64 components.
QUERY_BLOCK = 16_384
#: Vectors from which the marks between cells are set. Any marks give right results; good ones give tight bounds.
MARK_SAMPLE = 4_096
#: Cells of a component, one byte each.
CELLS = 256
#: Bounds that one step of a scan holds, and candidates that a task holds before it passes them on.
STEP, HELD = 1 << 22, 1 << 21


class Cells:
    """The cells of each component: lowest and highest value per code, at most CELLS codes."""

    def __init__(self, sample: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.dims, self.marks = len(low), []
        self.mid, self.half = np.zeros((self.dims, CELLS)), np.zeros((self.dims, CELLS))
        for d in range(self.dims):
            marks = np.unique(np.quantile(sample[:, d], np.arange(1, CELLS) / CELLS, method="nearest"))
            marks = marks[(marks > low[d]) & (marks <= high[d])]
            first, last = np.append(low[d], marks), np.append(marks - 1, high[d])
            self.marks.append(marks)
            self.mid[d, : len(first)], self.half[d, : len(first)] = (first + last) / 2, (last - first) / 2
        self.top = np.maximum(np.abs(low), np.abs(high)).astype(float)

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(m, x[:, d], "right") for d, m in enumerate(self.marks)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(self.dims)
        return self.mid[at, codes], self.half[at, codes]


def fit_cells(vectors: DataFrame) -> Cells:
    """Cells from the range of every component over all vectors and from quantiles of MARK_SAMPLE vectors, those with the
    lowest hashes of ids. Absent components count as 0."""
    ranges = vectors.select(F.posexplode("vector")).groupBy("pos").agg(F.min("col").alias("low"), F.max("col").alias("high")).orderBy("pos").collect()  # a row per component
    dims = max(len(ranges), 1)
    low, high = np.zeros(dims), np.zeros(dims)
    for r in ranges:
        low[r["pos"]], high[r["pos"]] = min(r["low"], 0), max(r["high"], 0)
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(MARK_SAMPLE).select("vector").toArrow()
    return Cells(matrix(sample["vector"], dims) if sample.num_rows else np.zeros((1, dims)), low, high)


def write_file(vectors: DataFrame, is_query: Column, k: int, cells: Cells) -> DataFrame:
    """The file, a row per distinct vector: key, vector, cells, its k + 1 least ids, and asks (whether a query has it).

    Equal vectors have equal scores and ties go to smaller ids, so k + 1 ids of a vector are all that a result can name. The
    limit per vector is applied before the shuffle too, so copies of one vector never meet in one task.
    """

    @F.arrow_udf(BinaryType())
    def code(x: pa.Array) -> pa.Array:
        codes = cells.encode(matrix(x, cells.dims))
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(cells.dims), len(codes), [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())

    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    firsts = vectors.distinct().withColumn("_n", place).where(F.col("_n") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = vectors.where(is_query).select("vector").distinct().withColumn("asks", F.lit(True))
    rows = firsts.join(asked, "vector", "left").select(F.monotonically_increasing_id().alias("key"), "vector", "ids", F.coalesce("asks", F.lit(False)).alias("asks"))
    path = fresh_dir(vectors.sparkSession, "vector-file")
    rows.withColumn("cells", code("vector")).write.parquet(path)
    return vectors.sparkSession.read.parquet(path)


def _scan(cells: Cells, queries, wanted: int):
    """Candidates (q, key, lower, upper) of a task: rows whose upper bound reaches the `wanted`-th best lower bound so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries.value
        lean = np.abs(q)
        # what rounding can add to a sum of so many products
        slack = (lean @ cells.top * (cells.dims + 2) * 2.0**-51)[:, None]
        best, held, n = np.full((len(q), wanted), -np.inf), [], 0
        step = max(STEP // len(q), 1)

        def flush():
            i, keys, low, up = (np.concatenate(x) for x in zip(*held, strict=True))
            ok = up >= best[i, 0]
            return pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (i.astype(np.int32), keys, low, up)], ["q", "key", "lower", "upper"])

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, cells.dims)
            for at in range(0, len(keys), step):
                mid, half = cells.decode(codes[at : at + step])
                centre, around = q @ mid.T, lean @ half.T + slack
                low, up = centre - around, centre + around
                best = np.partition(np.concatenate([best, low], axis=1), -wanted, axis=1)[:, -wanted:]
                best.sort(axis=1)
                i, j = np.nonzero(up >= best[:, :1])
                held.append((i, keys[at + j], low[i, j], up[i, j]))
                n += len(i)
                if n > HELD:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    return run


def _scores(cells: Cells, queries):
    """Exact integer inner products of candidates with their queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries.value.astype(np.int64)
        for batch in batches:
            own = q[batch.column("q").to_numpy(zero_copy_only=False)]
            score = np.einsum("nd,nd->n", own, matrix(batch.column("vector"), cells.dims).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("key"), batch.column("ids"), pa.array(score)], ["q", "key", "ids", "score"])

    return run


def _search_block(file: DataFrame, block: DataFrame, cells: Cells, k: int) -> DataFrame:
    """Hits of one block of queries (key, q, vector; q from 0 on): key and its k + 1 best (score, id, vector's key)."""
    spark, wanted = file.sparkSession, k + 1
    asked = block.orderBy("q").toArrow()  # QUERY_BLOCK rows at most
    queries = spark.sparkContext.broadcast(matrix(asked["vector"], cells.dims))
    found = cut(file.select("key", "cells").mapInArrow(_scan(cells, queries, wanted), "q int, key long, lower double, upper double"))
    by = Window.partitionBy("q")
    least = found.withColumn("_n", F.row_number().over(by.orderBy(F.desc("lower"), "key"))).where(F.col("_n") <= wanted).groupBy("q").agg(F.when(F.count("*") == wanted, F.min("lower")).alias("_least"))
    # a row per query of the block
    live = found.join(F.broadcast(least), "q").where("_least is null or upper >= _least").drop("_least")
    live = cut(live.withColumn("_n", F.row_number().over(by.orderBy(F.desc("upper"), "key"))))

    def exact(rows: DataFrame) -> DataFrame:
        read = hot_join(rows.select("q", "key"), file.select("key", "vector", "ids"), rows.groupBy("key").agg(F.count("*").alias("n")), "key", "q")
        return cut(read.select("q", "key", "ids", "vector").mapInArrow(_scores(cells, queries), "q int, key long, ids array<long>, score long"))

    first = exact(live.where(F.col("_n") <= 2 * wanted))
    certain = first.withColumn("_n", F.row_number().over(by.orderBy(F.desc("score"), "key"))).where(F.col("_n") == wanted).select("q", F.col("score").alias("_sure"))
    rest = exact(cut(live.where(F.col("_n") > 2 * wanted).join(F.broadcast(certain), "q").where("upper >= _sure")))
    named = first.union(rest).select("q", "key", "score", F.explode("ids").alias("id"))
    best = named.withColumn("_n", F.row_number().over(by.orderBy(F.desc("score"), "id", "key"))).where(F.col("_n") <= wanted)
    hits = best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("_n", "score", "id", F.col("key").alias("of")))).alias("hits"))
    return block.join(hits, "q").select("key", "hits")


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """The k highest inner products of each query with all other rows: query_id, rank (from 1), vec_id, score; ties go to the
    smaller id. `vectors` has vec_id and vector (array<int>, see grid_vectors); `is_query` tells queries by vec_id.

    A vector-approximation file holds a byte per component. Each pass scans it for a block of queries and keeps rows whose
    bounds allow a place among the best; exact vectors of these are read in order of their bounds, first the 2 (k + 1) best
    of a query, then those whose bound still reaches its k-th exact score. Nothing that could win is left out. The number of
    passes grows with that of distinct query vectors, as every query meets every row.

    Defined cases: null ids take no part; rows equal in id and vector count once; equal ids with different vectors are
    different rows; a query's own row is no candidate; with k rows or fewer beside the query all are returned; absent
    components of shorter vectors count as 0; an empty table, or one without queries, gives an empty result.
    """
    vectors = vectors.where("vec_id is not null").select("vec_id", "vector")
    spark = vectors.sparkSession
    cells = fit_cells(vectors)
    file = write_file(vectors, is_query, k, cells)
    asked = running_sums(file.where("asks").select("key", "vector"), [F.col("key")], {"at": F.lit(1)})
    asked = cut(asked.select("key", "vector", F.floor(F.col("at") / QUERY_BLOCK).cast("int").alias("block"), (F.col("at") % QUERY_BLOCK).cast("int").alias("q")))
    path = fresh_dir(spark, "hits")
    blocks = -(-asked.count() // QUERY_BLOCK)
    for b in range(blocks):
        _search_block(file, asked.where(F.col("block") == b).drop("block"), cells, k).write.parquet(f"{path}/block={b}")
    schema = "key long, hits array<struct<_n:int,score:long,id:long,of:long>>"
    hits = spark.read.schema(schema).parquet(path) if blocks else spark.createDataFrame([], schema)
    queries = vectors.where(is_query).distinct()
    counts = cut(queries.groupBy("vector").agg(F.count("*").alias("n")))
    rows = hot_join(queries, asked.select("key", "vector").join(hits.select("key", "hits"), "key"), counts, "vector", "vec_id")
    others = F.filter("hits", lambda h: (h["id"] != F.col("vec_id")) | (h["of"] != F.col("key")))
    out = rows.select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(others, 1, k)))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.id").alias("vec_id"), F.col("col.score").alias("score"))
