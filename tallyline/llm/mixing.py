"""Mixing sources to target weights by cube-method balanced sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import textspans as ts
from .cluster import cut, fresh_names, running_sums

#: Units of one flight task; larger strata are flown in blocks first, their few open units again, and so on.
BLOCK_UNITS = 4096
#: Units of a block, evenly spaced by size, that stay out of its flight. The landing needs them: a unit is settled well only
#: beside one of about its size, so it must be able to go from long to short by small steps.
RESERVE = 64
_EPS = 1e-9


@F.arrow_udf(LongType())
def count_words(texts: pa.Array) -> pa.Array:
    return pa.array(ts.word_counts(texts))


def water_levels(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """Add rank, target to (source, source_size): weights repeat over sources in code-point order, null last; shares of
    the total stop at cap * source_size, the excess going to the others by weight.

    The level L with sum(min(cap * size, L * weight)) = total comes from running sums over the sources by cap / weight.
    One row per source; running_sums() keeps even that distributed. Sources without words get 0.
    """
    ranked = running_sums(sources, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)})
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = cut(ranked.withColumn("w", w).withColumn("top", F.col("source_size") * cap))
    below = running_sums(ranked, [F.col("top") / F.col("w"), F.col("rank")], {"top_below": F.col("top"), "w_below": F.col("w")})
    total = ranked.agg(F.sum("source_size").alias("all_size"), F.sum("w").alias("all_w"))
    level = (F.col("all_size") - F.col("top_below")) / (F.col("all_w") - F.col("w_below"))
    # both are single rows
    level = below.join(F.broadcast(total)).withColumn("level", level).where(F.col("level") * F.col("w") <= F.col("top") * (1 + 1e-12)).agg(F.min(F.struct(F.col("top") / F.col("w"), "rank", "level")).alias("x"))
    out = ranked.join(F.broadcast(level))
    return out.select("source", "source_size", "rank", F.least("top", F.coalesce(F.col("x.level") * F.col("w"), "top")).alias("target"))


def _step(x: np.ndarray, u: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Move along u or against it until a unit is settled; the odds of both ways keep each expectation."""
    u = u / np.abs(u).max()
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.where(u > 0, (1 - x) / u, np.where(u < 0, -x / u, np.inf)).min()
        down = np.where(u > 0, x / u, np.where(u < 0, (x - 1) / u, np.inf)).min()
    x = x + up * u if draw.random() * (up + down) < down else x - down * u
    x[x < _EPS], x[x > 1 - _EPS] = 0.0, 1.0
    return x


def _flight(pi: np.ndarray, mass: np.ndarray, count: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Fast cube flight: move three units at a time along the null space of (mass, count) until one is settled.

    With a_i = (mass_i, count_i) the direction is the cross product of both rows, so sum(pi * mass) and
    sum(pi * count) stay as they are; the two step lengths are drawn so that each pi keeps its expectation.
    """
    pi = pi.copy()
    rest = iter(range(len(pi)))
    held = [i for _, i in zip(range(3), rest, strict=False)]
    while len(held) == 3:
        a, b, c = held
        u = np.array([mass[b] * count[c] - mass[c] * count[b], mass[c] * count[a] - mass[a] * count[c], mass[a] * count[b] - mass[b] * count[a]])
        if not u.any():  # all rows are proportional
            u = np.array([count[b] or mass[b] or 1.0, -(count[a] or mass[a] or 1.0), 0.0])
        x = pi[held]
        x = _step(x, u, draw)
        pi[held] = x
        open_ = [i for i, v in zip(held, x, strict=True) if 0 < v < 1]
        held = open_ + [i for _, i in zip(range(3 - len(open_)), rest, strict=False)]
    return pi


def _landing(pi: np.ndarray, mass: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Settle the units that a flight leaves open, given from long to short, by dropping constraints: two at a time are
    moved so that their mass stays, and the last one, mostly among the shortest, is drawn. Each pi keeps its expectation."""
    pi, a = pi.copy(), -1
    for b in np.flatnonzero((pi > 0) & (pi < 1)).tolist():
        if a >= 0:
            u = np.array([mass[b], -mass[a]]) if mass[a] or mass[b] else np.array([1.0, -1.0])
            pi[[a, b]] = _step(pi[[a, b]], u, draw)
        a = next((i for i in (a, b) if i >= 0 and 0 < pi[i] < 1), -1)
    if a >= 0:
        pi[a] = float(draw.random() < pi[a])
    return pi


def _fly(seed: int):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        # from long to short, so that what stays open is short
        g = g.sort_values(["mass", "doc_id", "size"], ascending=[False, True, True], kind="stable", na_position="last").reset_index(drop=True)
        name = "" if pd.isna(g["source"].iloc[0]) else str(g["source"].iloc[0])
        draw = np.random.default_rng([seed, len(g), int(g["block"].iloc[0]), *name.encode()])
        mass, count = g["mass"].to_numpy(float), g["mult"].to_numpy(float)
        pi, last = g["pi"].to_numpy(float).copy(), g["blocks"].iloc[0] == 1
        flown = np.ones(len(g), bool)
        flown[np.unique(np.linspace(0, len(g) - 1, min(RESERVE, (len(g) + 1) // 2)).round().astype(int))] = False
        pi[flown] = _flight(pi[flown], mass[flown], count[flown], draw)
        return g.assign(pi=_landing(pi, mass, draw) if last else pi)

    return run


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 7) -> DataFrame:
    """How often each document enters the mix: id, source, size, source_size, target (of its source), copies, mult.

    A source is to be read target / source_size times. Each of its documents is taken the whole part of that, and one
    more time for a balanced sample whose inclusion probability is the fraction: the cube method keeps the sample's
    words and documents at their expected totals until RESERVE + 2 documents at most are left for a source. These are landed
    by dropping the constraints, documents first, so every document keeps its probability, and a source's words are off
    its target by less than the last document, mostly one of the shortest. A source is landed when it fits one block,
    whatever the size of the others. Draws depend on (seed, source, block) alone: reruns agree, wherever rows lie.

    Defined cases: null and empty texts have size 0; a null source is a source of its own, last in order; rows that agree
    in id, source and size are one unit and share one decision (`mult` says how many rows it stands for); an empty
    table gives an empty result. Sources without words take nothing, documents without words follow the same
    sampling. Extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), count_words(F.col(text_col).cast("string")).alias("size"))
    units = cut(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("mult")))
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("mult")).alias("source_size"))
    targets = cut(water_levels(sources, weights, cap)).withColumnRenamed("source", "_s")
    rate = F.when(F.col("source_size") > 0, F.round(F.least(F.col("target") / F.col("source_size"), F.lit(cap)), 12)).otherwise(F.lit(0.0))
    known = units.join(targets, F.col("source").eqNullSafe(F.col("_s"))).withColumn("rate", rate)
    known = known.withColumns({"base": F.floor("rate").cast("long"), "pi": F.col("rate") - F.floor("rate"), "mass": (F.col("size") * F.col("mult")).cast("double")})
    state = known.select("doc_id", "source", "size", "mult", "source_size", "target", "base", "pi", "mass")
    done, todo, level = state.where("pi <= 0"), state.where("pi > 0"), 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    while True:
        strata = todo.groupBy("source").agg(F.ceil(F.count("*") / BLOCK_UNITS).cast("int").alias("blocks")).withColumnRenamed("source", "_s")
        top = strata.agg(F.max("blocks")).first()[0]
        if top is None:
            break
        dealt = todo.join(strata, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("block", F.pmod(F.xxhash64("doc_id", "size", F.lit(level)), "blocks").cast("int"))
        # with a number of partitions, adaptive execution leaves the blocks spread over tasks
        flights = dealt.repartition(parts, "source", "block").groupBy("source", "block")
        flown = cut(flights.applyInPandas(_fly(seed + level), dealt.schema).drop("block", "blocks"))
        done, todo, level = done.union(flown.where("pi <= 0 or pi >= 1")), flown.where("pi > 0 and pi < 1"), level + 1
        if top == 1:
            break
    return done.select(F.col("doc_id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (F.col("base") + F.col("pi").cast("long")).alias("copies"), "mult")


def take_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The documents of the mix with their own columns, each row as often as mix_sources() takes it.

    Defined cases: as there; rows with a null id or source and rows without words are sampled like others, rows that agree
    in id, source and size come equally often, an empty table stays empty, and columns may have any names.
    """
    id_, source, size, copies, own, copy = fresh_names(docs, "id", "source", "size", "copies", "own", "copy")
    plan = mix_sources(docs, id_col, source_col, text_col, **options).where("copies > 0")
    plan = plan.select(F.col(id_col).alias(id_), F.col(source_col).alias(source), F.col("size").alias(size), F.col("copies").cast("int").alias(copies))
    sized = docs.withColumn(own, count_words(F.col(text_col).cast("string")))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(id_)) & F.col(source_col).cast("string").eqNullSafe(F.col(source)) & (F.col(own) == F.col(size))
    taken = sized.join(plan, same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return taken.select(docs.columns)
