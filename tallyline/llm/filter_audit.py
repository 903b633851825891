"""How filters interact: every order of them, from one table of failure masks and a Gray-code walk over subsets."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import cut

_WHITE = r"[\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """The filters on one text (not null): whether it fails. A: under 200 words; B: fewer distinct words than half of all; C: more
    than 3 % capitals A-Z; D: any of # $ % & * |."""
    words = F.filter(F.split(text, _WHITE), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": F.size(words) < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), "C": 100 * capitals > 3 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def failure_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> tuple[DataFrame, str]:
    """Documents counted by what they fail: part, mask (bit i: filter i of the letters), n, good, toxic; and the letters.

    The last filter, E, fails a document whose whole text a document of smaller id has. Texts are told apart by SHA-256.
    Equal texts meet only as partial minima of their ids and are then looked up by (text, id), so a text that a third of all
    documents share is no hot key; neither are repeated rows, which are counted before.

    Null texts and parts count as empty. A null id is neither smaller nor larger than any: it fails nothing by E and has no
    labels. Of several labels of a document any 1 counts. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    tests = text_filters(F.col("_text"))
    bits = sum((F.coalesce(c, F.lit(False)).cast("int") * 2**i for i, c in enumerate(tests.values())), F.lit(0))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("_text"))
    rows = rows.select("doc_id", "part", F.sha2("_text", 256).alias("digest"), bits.alias("mask"))
    rows = cut(rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n")))
    firsts = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    known = labels.where(f"`{id_col}` is not null").groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    seen = rows.join(firsts, ["digest", "doc_id"], "left").join(known, "doc_id", "left")
    repeats = F.col("_first").isNull() & F.col("doc_id").isNotNull()
    seen = seen.withColumn("mask", F.col("mask") + F.when(repeats, 2 ** len(tests)).otherwise(0))
    count = lambda flag: F.sum(F.col("n") * F.coalesce(flag, F.lit(0))).cast("long")
    cells = seen.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good").alias("good"), count("toxic").alias("toxic"))
    return cells, "".join(tests) + "E"


def gray_states(cells: np.ndarray) -> np.ndarray:
    """What survives under every subset of filters: cells (parts, masks, measures) to states of the same shape, by subset.

    The walk toggles one filter at a time, in Gray-code order. Each mask cell counts the active filters that it fails; cells
    whose counter leaves 0 go from the running survivors, those whose counter comes back to 0 return to them.
    """
    masks = np.arange(cells.shape[1])
    failing, alive, subset = np.zeros(len(masks), int), cells.sum(axis=1), 0
    states = np.empty_like(cells)
    states[:, 0] = alive
    for step in range(1, len(masks)):
        bit = step & -step
        hit = (masks & bit) > 0
        subset ^= bit
        if subset & bit:
            alive = alive - cells[:, hit & (failing == 0)].sum(axis=1)
            failing[hit] += 1
        else:
            failing[hit] -= 1
            alive = alive + cells[:, hit & (failing == 0)].sum(axis=1)
        states[:, subset] = alive
    return states


def _report(letters: str):
    m = len(letters)
    orders = list(permutations(range(m)))
    filters = np.array(orders)
    after = np.cumsum(1 << filters, axis=1)
    before = after - (1 << filters)
    names = np.repeat(["".join(letters[i] for i in o) for o in orders], m)
    flat, old, new = filters.ravel(), before.ravel(), after.ravel()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cells = np.zeros((len(frame), 1 << m, 3), np.int64)
            for p, rows in enumerate(frame["cells"]):
                for r in rows:
                    cells[p, r["mask"]] = r["n"], r["good"], r["toxic"]
            states = gray_states(cells)
            alone = states[:, [((1 << m) - 1) ^ (1 << i) for i in range(m)], 0] - states[:, -1:, 0]
            fails = states[:, :1, 0] - states[:, [1 << i for i in range(m)], 0]
            shapley = np.zeros_like(fails)
            for i in range(m):
                for s in range(1 << m):
                    if not s >> i & 1:
                        shapley[:, i] += factorial(s.bit_count()) * factorial(m - 1 - s.bit_count()) * (states[:, s, 0] - states[:, s | 1 << i, 0])
            gone = states[:, old] - states[:, new]
            for p, part in enumerate(frame["part"]):
                yield pd.DataFrame({
                    "part": part, "filter_order": names, "step": np.tile(np.arange(1, m + 1, dtype=np.int32), len(orders)), "kept": states[p, new, 0], "removed": gone[p, :, 0],
                    "redundant": fails[p, flat] - gone[p, :, 0], "unique_fails": alone[p, flat], "good_lost": gone[p, :, 1], "toxic_lost": gone[p, :, 2], "shapley": shapley[p, flat],
                })

    return run


def interaction_report(cells: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of filters and step: kept, removed, redundant (fails this filter, removed earlier), unique_fails,
    good_lost, toxic_lost, shapley (removed by this filter, summed over all orders).

    A part has at most 2 ** len(letters) cells; they are gathered per part, walked once, and every step is the difference of two
    of the stored states. Parts without documents do not occur; an empty table gives an empty result.
    """
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return parts.mapInPandas(_report(letters), "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")
