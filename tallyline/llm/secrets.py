"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds what they miss."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textspans as ts
from .cluster import cut

#: Documents with a pattern match, and as many without, that the field is fitted on, at most.
FIT_DOCS = 3000
#: Characters of a document that the field is fitted on, at most; with FIT_DOCS it bounds what comes to the driver. The scan
#: itself has no bound.
FIT_CHARS = 20_000
#: Words on either side of a suspicious word that are tagged with it.
REACH = 2
KINDS = ("assign", "access", "hex", "field")
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_BEGIN, _INSIDE, _OUTSIDE = 0, 1, 2


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the fixed patterns, leftmost and non-overlapping within a kind."""
    out = []
    lower = text.lower()
    if any(k in lower for k in _KEYS):
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    return sorted(out + [(m.start(), m.end(), 2) for m in _HEX.finditer(text)], key=lambda x: (x[0], x[2]))


def _byte_class(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(chars))


_DIGITS, _LOWERS, _UPPERS = _byte_class(b"0123456789"), _byte_class(bytes(range(97, 123))), _byte_class(bytes(range(65, 91)))
_HEXES, _JOINS, _ASSIGNS = _byte_class(b"0123456789abcdef"), _byte_class(b"-_+/="), _byte_class(b":=")
_OWN = 22  # features of one word
_KEY_FEATURES = (1, 3)  # those that look at key names


def _word_features(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shape features of each word (words x _OWN, 0/1), and which words are suspicious."""

    def count(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(table[buf], out=sums[1:])
        return sums[e] - sums[s]

    n = e - s
    digits, lowers, uppers = count(_DIGITS), count(_LOWERS), count(_UPPERS)
    joins, assigns, hexes = count(_JOINS), count(_ASSIGNS), count(_HEXES)
    change = np.zeros(len(buf), np.int32)
    kind = _DIGITS[buf].astype(np.int8) + 2 * _UPPERS[buf].astype(np.int8)
    change[1:] = kind[1:] != kind[:-1]
    sums = np.concatenate([[0], np.cumsum(change)])
    changes = sums[e] - sums[np.minimum(s + 1, e)]
    odd = (digits > 0) | (assigns > 0) | ((uppers > 1) & (lowers > 0)) | (n >= 24)
    key = np.zeros(len(s), bool)
    raw = buf.tobytes().lower()
    for name in (*_KEYS, "credential", "authorization", "bearer", "private", "pwd"):
        at, text = 0, name.encode()
        while (at := raw.find(text, at)) >= 0:
            i = int(np.searchsorted(s, at, "right")) - 1
            if i >= 0 and at < e[i]:
                key[i] = True
            at += len(text)
    alnum = digits + lowers + uppers
    cols = [np.ones(len(s), bool), key, assigns > 0, key & (assigns > 0), n <= 2, (n > 2) & (n <= 6), (n > 6) & (n <= 12), (n > 12) & (n <= 20), (n > 20) & (n <= 32), n > 32]
    cols += [digits > 0, digits == alnum, (digits > 0) & (uppers > 0) & (lowers == 0), (digits > 0) & (lowers > 0) & (uppers == 0), (digits > 0) & (lowers > 0) & (uppers > 0)]
    cols += [hexes == n, hexes >= np.maximum(n - 3, 8), joins > 0, changes >= 3, changes >= 6, 3 * digits >= n, alnum < n - 3]
    return np.stack(cols, 1), odd | key


@dataclass
class SecretField:
    """Weights of the field: emissions (tags x features) and transitions, a word outside being certain far from
    suspicious ones."""

    emit: np.ndarray
    move: np.ndarray


def _segments(feats: np.ndarray, suspicious: np.ndarray, doc_offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word indices to tag, in runs: (first, end) of each run, and the features of words with those of both neighbours
    and of their document (the share of suspicious words, in three steps)."""
    near = suspicious.copy()
    doc = np.repeat(np.arange(len(doc_offs) - 1), np.diff(doc_offs))
    for d in range(1, REACH + 1):
        near[d:] |= suspicious[:-d] & (doc[d:] == doc[:-d])
        near[:-d] |= suspicious[d:] & (doc[:-d] == doc[d:])
    first, end, _ = ts.runs(near, doc_offs)
    at = np.flatnonzero(near)
    same = lambda d: (at + d >= 0) & (at + d < len(doc)) & (doc[np.clip(at + d, 0, len(doc) - 1)] == doc[at])
    side = lambda d: feats[np.clip(at + d, 0, len(doc) - 1)] & same(d)[:, None]
    sums = np.concatenate([[0], np.cumsum(suspicious)])
    share = (sums[doc_offs[1:]] - sums[doc_offs[:-1]]) / np.maximum(np.diff(doc_offs), 1)
    file = np.stack([share[doc[at]] > x for x in (0.02, 0.1, 0.3)], 1)
    x = np.concatenate([feats[at], side(-1), side(-2), side(1), file], 1).astype(np.float64)
    return first, end, x


N_FEATURES = 4 * _OWN + 3


def _padded(first: np.ndarray, end: np.ndarray, emit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of equal length together: (positions runs x length, emissions runs x length x tags)."""
    start = np.concatenate([[0], np.cumsum(end - first)])[:-1]
    for size in np.unique(end - first):
        rows = start[end - first == size][:, None] + np.arange(size)
        yield rows, emit[rows]


def viterbi(field: SecretField, first: np.ndarray, end: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The best tag of every word of the runs; a run begins and ends beside words that are outside."""
    tags = np.full(len(x), _OUTSIDE, np.int8)
    emit = x @ field.emit.T
    for rows, e in _padded(first, end, emit):
        score = e[:, 0] + field.move[_OUTSIDE]
        back = []
        for t in range(1, rows.shape[1]):
            options = score[:, :, None] + field.move
            back.append(options.argmax(1))
            score = options.max(1) + e[:, t]
        best = (score + field.move[:, _OUTSIDE]).argmax(1)
        for t in range(rows.shape[1] - 1, -1, -1):
            tags[rows[:, t]] = best
            if t:
                best = back[t - 1][np.arange(len(best)), best]
    return tags


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (np.log(np.exp(a - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def fit_field(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], steps: int = 200, ridge: float = 0.02) -> SecretField:
    """Conditional likelihood by gradient ascent with Adam; runs hold (first, end, features, tags) per batch."""
    forbidden = np.zeros((3, 3))
    forbidden[_OUTSIDE, _INSIDE] = -50.0  # a secret begins before it goes on
    x, tags = np.concatenate([r[2] for r in runs]), np.concatenate([r[3] for r in runs])
    sizes = np.concatenate([r[1] - r[0] for r in runs])
    start = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    groups = [start[sizes == n][:, None] + np.arange(n) for n in np.unique(sizes)]
    w = np.zeros(3 * x.shape[1] + 9)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        emit_w, move = w[:-9].reshape(3, -1), w[-9:].reshape(3, 3) + forbidden
        emit = x @ emit_w.T
        expect, moves = np.zeros_like(emit), np.zeros((3, 3))
        for rows in groups:
            e, n = emit[rows], rows.shape[1]
            fwd, bwd = [e[:, 0] + move[_OUTSIDE]], [np.repeat(move[None, :, _OUTSIDE], len(rows), 0)]
            for t in range(1, n):
                fwd.append(_log_sum(fwd[-1][:, :, None] + move, 1) + e[:, t])
            for t in range(n - 2, -1, -1):
                bwd.append(_log_sum(move[None] + (e[:, t + 1] + bwd[-1])[:, None, :], 2))
            bwd = bwd[::-1]
            z = _log_sum(fwd[-1] + bwd[-1], 1)
            for t in range(n):
                expect[rows[:, t]] = np.exp(fwd[t] + bwd[t] - z[:, None])
                if t:
                    moves += np.exp(fwd[t - 1][:, :, None] + move + (e[:, t] + bwd[t])[:, None, :] - z[:, None, None]).sum(0)
                    np.subtract.at(moves, (tags[rows[:, t - 1]], tags[rows[:, t]]), 1)
            for edge, p in ((0, fwd[0] + bwd[0]), (n - 1, fwd[-1] + bwd[-1])):
                p = np.exp(p - z[:, None]).sum(0)
                seen = np.bincount(tags[rows[:, edge]], minlength=3)
                if edge == 0:
                    moves[_OUTSIDE] += p - seen
                if edge == n - 1 and (edge or n == 1):
                    moves[:, _OUTSIDE] += p - seen
        expect[np.arange(len(tags)), tags] -= 1
        grad = np.concatenate([(expect.T @ x).ravel(), moves.ravel()]) / len(start) + ridge * w / 10
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return SecretField(w[:-9].reshape(3, -1), w[-9:].reshape(3, 3) + forbidden)


def _tagged_batch(texts: list[str | None]):
    """Chunks of texts as (texts, byte buffer, doc offsets, word starts, ends, word offsets, features, suspicious)."""
    for lo, hi, buf, offs in ts.text_chunks(pa.array(texts, pa.string())):
        s, e, wo = ts.words(buf, offs)
        feats, odd = _word_features(buf, s, e)
        yield lo, hi, buf, offs, s, e, wo, feats, odd


def training_runs(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs with tags from the fixed patterns: the words that a span overlaps are begin, then inside."""
    out = []
    for lo, _, buf, offs, s, e, wo, feats, odd in _tagged_batch(texts):
        tags = np.full(len(s), _OUTSIDE, np.int8)
        for d in range(len(offs) - 1):
            raw = texts[lo + d] or ""
            for a, b, _ in pattern_spans(raw):
                at = offs[d] + len(raw[:a].encode())
                i, j = np.searchsorted(e, at, "right"), np.searchsorted(s, at + len(raw[a:b].encode()), "left")
                new = slice(i, min(j, wo[d + 1]))
                tags[new] = np.where(tags[new] == _OUTSIDE, _INSIDE, tags[new])
                if tags[i] == _INSIDE and (i == wo[d] or tags[i - 1] == _OUTSIDE):
                    tags[i] = _BEGIN
        first, end, x = _segments(feats, odd, wo)
        at = np.concatenate([np.arange(a, b) for a, b in zip(first, end, strict=True)]) if len(first) else np.zeros(0, int)
        tag = tags[at]
        tag[tag == _INSIDE] = np.where((np.concatenate([[_OUTSIDE], tag[:-1]]) == _OUTSIDE)[tag == _INSIDE], _BEGIN, _INSIDE)
        out.append((first, end, x, tag))
    return out


def train_secret_field(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS) -> SecretField | None:
    """Fit the field on at most `fit_docs` documents with a pattern match and as many without, of at most `fit_chars`
    characters each: those of the lowest hashes of id and text.

    The patterns label the words (distant supervision); the field sees shapes and neighbours only, so it carries over to
    secrets of other names and lengths. Patterns are tried on some 20 * fit_docs documents of the lowest hashes, and on
    twice as many as long as either kind is short of `fit_docs` and documents are left. None if no document holds a match.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("h"))
    rows = rows.where(F.length("text") <= fit_chars)
    hit = F.lower("text").rlike("(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]") | F.col("text").rlike("AKIA[A-Z0-9]{16}|[0-9a-f]{24}")
    share = min(1.0, 20 * fit_docs / max(docs.count(), 1))
    while True:
        below = F.col("h") <= F.lit(int((share - 0.5) * 2**64 - 1) if share < 1 else 2**63 - 1)
        tried = cut(rows.where(below).select("h", hit.alias("hit")).distinct())
        # the hashes are ranked alone, so that only the chosen texts travel
        last = {k: tried.where(F.col("hit") == k).orderBy("h").limit(fit_docs).agg(F.count("*"), F.max("h")).first() for k in (True, False)}
        if share >= 1 or all(n == fit_docs for n, _ in last.values()):
            break
        share = min(1.0, 2 * share)
    chosen = [(F.col("hit") == k) & (F.col("h") <= F.lit(h)) for k, (n, h) in last.items() if n]
    if not chosen:
        return None
    near = rows.where(F.col("h") <= F.lit(max(h for n, h in last.values() if n))).withColumn("hit", hit)
    found = near.where(reduce(or_, chosen)).dropDuplicates(["h"]).select("hit", "text").collect()
    texts = [t for _, t in sorted((not hit, text) for hit, text in found)]
    runs = [r for r in training_runs(texts) if len(r[0])]
    if not any((r[3] != _OUTSIDE).any() for r in runs):
        return None
    return fit_field(runs + [nameless(r) for r in runs])


def nameless(run: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The run without the features of key names, so that the field also learns secrets by their own shape."""
    first, end, x, tags = run
    x = x.copy()
    for block in range(4):
        x[:, [block * _OWN + i for i in _KEY_FEATURES]] = 0
    return first, end, x, tags


def scan_texts(texts: list[str | None], field: SecretField | None) -> list[list[tuple[int, int, int]]]:
    """All spans of each text in code points: the patterns', and those of the field that touch none of them."""
    out: list[list[tuple[int, int, int]]] = []
    for lo, hi, buf, offs, s, e, wo, feats, odd in _tagged_batch(texts):
        added: list[list[tuple[int, int]]] = [[] for _ in range(hi - lo)]
        if field is not None and odd.any():
            first, end, x = _segments(feats, odd, wo)
            tags = viterbi(field, first, end, x)
            at = np.concatenate([np.arange(a, b) for a, b in zip(first, end, strict=True)])
            full = np.full(len(s) + 1, _OUTSIDE, np.int8)
            full[at] = tags
            begins = np.flatnonzero(full == _BEGIN)
            for i in begins.tolist():
                d = int(np.searchsorted(wo, i, "right")) - 1
                j = i + 1
                while j < wo[d + 1] and full[j] == _INSIDE:
                    j += 1
                added[d].append((int(s[i] - offs[d]), int(e[j - 1] - offs[d])))
        for d in range(hi - lo):
            text = texts[lo + d] or ""
            spans = pattern_spans(text)
            if added[d]:
                raw = text.encode()
                for a, b in added[d]:
                    piece = raw[a:b].decode()
                    cut = len(piece) - len(piece.lstrip("\"'([{<,;"))
                    piece = piece.lstrip("\"'([{<,;").rstrip("\"')]}>,;.:!?")
                    start = len(raw[:a].decode()) + cut
                    if piece and not any(p < start + len(piece) and start < q for p, q, k in spans if k < 3):
                        spans.append((start, start + len(piece), 3))
                spans.sort(key=lambda x: (x[0], x[2]))
            out.append(spans)
    return out


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan_secrets(docs: DataFrame, field: SecretField | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_assign, n_access, n_hex, n_field, base_spans, spans; spans are kind:start:end in code
    points, end exclusive, ordered by start and then kind.

    The patterns' spans always stay; the field adds spans that touch none of them. Every word of a whole text is tagged:
    words further than REACH from a suspicious one are outside by the model's definition, so that the best tags of the
    runs between them are those of the whole text.

    Defined cases: null text counts as empty and has no spans; null ids and repeated rows are scanned per row; an empty
    table gives an empty result; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                found = scan_texts(batch.column(1).slice(at, 500).to_pylist(), field)
                counts = [pa.array([sum(x[2] == k for x in f) for f in found], pa.int64()) for k in range(4)]
                base = pa.array([_join([x for x in f if x[2] < 3]) for f in found], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 500), *counts, base, pa.array([_join(f) for f in found], pa.string())], ["id", "n_assign", "n_access", "n_hex", "n_field", "base_spans", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_assign long, n_access long, n_hex long, n_field long, base_spans string, spans string").withColumnRenamed("id", id_col)


def redact(text: str | None, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str | None:
    """The text with every span replaced."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if b > at:
            out += [text[at : max(a, at)], mark if a >= at else ""]
            at = b
    return "".join([*out, text[at:]])


def digest(base_spans: str) -> str:
    """Lower-case hex SHA-256 of a span list."""
    return hashlib.sha256(base_spans.encode()).hexdigest()
