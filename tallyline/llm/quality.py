"""Quality rules: rule statistics per document and an isolation forest over them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textspans as ts

#: Labelled rows that the forest and its threshold are fitted on, at most.
FIT_ROWS = 20_000
TREES, TREE_ROWS, SEED = 100, 256, 11
#: Cuts reach this many standard deviations of the labelled rows beyond what a node has seen.
MARGIN = 1.0
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_PUNCT = np.isin(np.arange(256), list(b"!?;:()[]{}\"'/\\=+_^~`@"))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])
_LEAD = (np.arange(256) & 0xC0) != 0x80
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("word_length", "symbols", "punctuation", "upper_case", "letters", "lone_marks")


def _per_doc(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]


def _dup_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def _repeat_words(h: np.ndarray, at: np.ndarray, wo: np.ndarray) -> np.ndarray:
    """Words in a 3-word window that occurs twice or more in the same document."""
    doc = np.searchsorted(wo, at, "right") - 1
    key = ts.mix64(h + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    hit = at[count[inverse] > 1]
    marked = np.zeros(int(wo[-1]), bool)
    for j in range(3):
        marked[hit + j] = True
    return _per_doc(marked, wo)


def rule_statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS (int64) and FEATURES (float64) of each text, as matrices with a row per text."""
    counts, feats = np.zeros((len(texts), len(COUNTS)), np.int64), np.zeros((len(texts), len(FEATURES)))
    for lo, hi, buf, offs in ts.text_chunks(texts):
        s, e, wo = ts.words(buf, offs)
        n = np.diff(wo)
        inside = ~ts.SPACE[buf]
        chars = _per_doc(inside & _LEAD[buf], offs)
        symbols = _per_doc(_SYMBOLS[buf], offs)
        raw = buf.tobytes()
        cuts = offs.tolist()
        dups = np.array([_dup_lines(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], np.int64)
        h, at = ts.windows(ts.span_hashes(buf, s, e), wo, 3)
        repeats = _repeat_words(h, at, wo) if len(at) else np.zeros(hi - lo, np.int64)
        counts[lo:hi] = np.stack([n, chars, symbols, dups, repeats], 1)
        each, per_word = np.maximum(_per_doc(inside, offs), 1), np.maximum(n, 1)
        letters = np.maximum(_per_doc(_LETTER[buf], offs), 1)
        alone = _per_doc((e - s == 1) & ~_LETTER[buf[s]], wo) if len(s) else np.zeros(hi - lo)
        cols = [np.minimum(chars / per_word, 40), np.log1p(20 * symbols / per_word), np.log1p(20 * _per_doc(_PUNCT[buf], offs) / per_word), _per_doc(_UPPER[buf], offs) / letters, letters / each, np.log1p(20 * alone / per_word)]
        feats[lo:hi] = np.stack(cols, 1)
    return counts, feats


def base_fails(counts: np.ndarray) -> np.ndarray:
    """The fixed rules: fewer than 50 words, or more than half of the words in repeated windows."""
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


def _path_constant(n: np.ndarray) -> np.ndarray:
    n = np.maximum(np.asarray(n, float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / n, (n == 2).astype(float))


@dataclass
class IsolationForest:
    """Random trees as flat arrays; a row's score falls with its mean path length (1 is most anomalous)."""

    feature: np.ndarray
    split: np.ndarray
    size: np.ndarray
    depth: int
    rows: int
    threshold: float = np.inf

    @classmethod
    def fit(cls, x: np.ndarray, margin: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = SEED) -> IsolationForest:
        """Each tree isolates a random subsample: a random feature and a random cut within its range and a margin on
        either side (so that rows outside the range leave early, also where the fitted rows are all alike), down to
        log2(rows) levels. Node i has children 2i+1 and 2i+2."""
        draw = np.random.default_rng(seed)
        rows = min(rows, len(x))
        depth = max(1, int(np.ceil(np.log2(max(rows, 2)))))
        nodes = 2 ** (depth + 1) - 1
        feature, split, size = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes), np.int64)
        for t in range(trees):
            held = {0: x[draw.choice(len(x), rows, replace=False)]}
            for i in range(nodes):
                part = held.pop(i, None)
                if part is None:
                    continue
                size[t, i] = len(part)
                low, high = part.min(0), part.max(0)
                if 2 * i + 2 < nodes and len(part) > 1:
                    f = draw.integers(x.shape[1])
                    feature[t, i], split[t, i] = f, draw.uniform(low[f] - margin[f], high[f] + margin[f])
                    left = part[:, f] < split[t, i]
                    held[2 * i + 1], held[2 * i + 2] = part[left], part[~left]
                    for c in (2 * i + 1, 2 * i + 2):
                        if not len(held[c]):
                            held.pop(c)
        return cls(feature, split, size, depth, rows)

    def score(self, x: np.ndarray) -> np.ndarray:
        path = np.zeros(len(x))
        row = np.arange(len(x))
        for t in range(len(self.feature)):
            at, length = np.zeros(len(x), np.int64), np.zeros(len(x))
            for _ in range(self.depth):
                f = self.feature[t, at]
                go = f >= 0
                length += go
                at = np.where(go, 2 * at + 1 + (x[row, np.maximum(f, 0)] >= self.split[t, at]), at)
            path += length + _path_constant(self.size[t, at]) * (self.size[t, at] > 0)
        return 2 ** (-path / len(self.feature) / max(_path_constant(self.rows), 1e-9))

    def calibrate(self, x: np.ndarray, good: np.ndarray) -> None:
        """The threshold with the best balanced accuracy on labelled rows, in the middle of its gap; with one class
        only, nothing is rejected."""
        if good.all() or not good.any():
            self.threshold = np.inf
            return
        s = self.score(x)
        order = np.argsort(s, kind="stable")
        s, g = s[order], good[order]
        kept_good = np.concatenate([[0], np.cumsum(g)]) / g.sum()
        caught_bad = 1 - np.concatenate([[0], np.cumsum(~g)]) / (~g).sum()
        best = int(np.argmax(kept_good + caught_bad))
        self.threshold = np.inf if best == len(s) else -np.inf if best == 0 else float((s[best - 1] + s[best]) / 2)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, feats = rule_statistics(batch.column(1))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(feats) + 1, dtype=np.int32) * len(FEATURES)), feats.ravel())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base_fails(counts)), flat], ["quality", "failed", "x"])


def fit_forest(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> IsolationForest | None:
    """Fit on at most `fit_rows` labelled documents that pass the fixed rules, chosen by a hash of their id.

    Trees grow on rows labelled good, so that what they isolate quickly differs from good text; the threshold is
    calibrated on good and bad rows. Where labels of one id disagree, the lowest counts. None if no labelled row is left.

    Defined cases: null ids and labels take no part, null and empty texts fail the rules; where ids repeat, at most twice
    `fit_rows` rows are taken, by a hash of their figures, so that equal tables give equal forests wherever rows lie.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min(F.col(label_col).cast("int")).alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    # at most fit_rows small rows
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "_id")
    rows = rows.select("quality", "text").mapInArrow(_statistics, "quality int, failed boolean, x array<double>").where("not failed")
    rows = rows.orderBy(F.xxhash64("x", "quality"), "x", "quality").limit(2 * fit_rows).toPandas()  # a bound for ids that repeat
    rows = rows.assign(k=[tuple(v) for v in rows["x"]]).sort_values(["k", "quality"], kind="stable")  # whatever order they came in
    x, good = np.array(rows["k"].tolist()).reshape(-1, len(FEATURES)), rows["quality"].to_numpy() > 0
    if not len(x):
        return None
    forest = IsolationForest.fit(x[good] if good.any() else x, MARGIN * x.std(0))
    forest.calibrate(x, good)
    return forest


def _judge(forest: IsolationForest | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, feats = rule_statistics(batch.column(batch.num_columns - 1))
            failed = base_fails(counts)
            score = forest.score(feats) if forest else np.zeros(len(feats))
            kept = ~failed & (score <= forest.threshold if forest else True)
            cols = [pa.array(counts[:, i]) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols, pa.array(score), pa.array(failed), pa.array(kept)], [*batch.schema.names[:-1], *COUNTS, "anomaly_score", "base_failed", "kept"])

    return run


def judge_quality(docs: DataFrame, forest: IsolationForest | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, the counts, anomaly_score, base_failed, kept.

    kept is false if a fixed rule fails, else whether the forest scores the text at or below its threshold; without a
    forest only the fixed rules decide. Whole texts count; words are [^\\x20\\x09-\\x0D]+.

    Defined cases: null and empty texts have no words and fail; null ids and repeated rows are judged per row; an empty
    table gives an empty result; other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_judge(forest), f"id long, {', '.join(f'{c} long' for c in COUNTS)}, anomaly_score double, base_failed boolean, kept boolean")
    return out.withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, forest: IsolationForest | None, text_col: str = "text") -> DataFrame:
    """The documents that judge_quality() keeps, with their own columns, in one pass without a join.

    Defined cases: null and empty texts fail the fixed rules and go; null ids and repeated rows are judged per row; an
    empty table stays empty; other columns pass through, whatever their names.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, feats = rule_statistics(batch.column(at).cast(pa.string()))
            kept = ~base_fails(counts)
            if forest:
                kept &= forest.score(feats) <= forest.threshold
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
