"""Line dedup with a fixed-depth template tree: lines that recur across documents, up to variable fields, are dropped."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textspans as ts
from .cluster import cut, hot_join

#: Leading tokens of a leaf.
DEPTH = 3
#: Share of a line's words without digits that its template must keep.
SIMILARITY = 0.6
#: Rarest and most common words of a line by which it finds templates.
ANCHORS = 2
#: Documents in which a template recurs.
MIN_DOCS = 10
#: Words of a line from which so many documents suffice, for the line itself.
LONG_LINES = ((50, 2), (8, 3))
BROADCAST_ROWS = 500_000
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_FIELD = np.uint64(0x51ED270B9F3A7C15)


def _lines(buf: np.ndarray, offs: np.ndarray, depth: int = DEPTH):
    """Every line with a word: (document, byte start, byte end, leaf hash, line hash, number of words).

    Words that hold a digit are variable fields and count as one symbol. The leaf is the number of words and the first
    `depth` of them; the line hash covers all words.
    """
    s, e, wo = ts.words(buf, offs)
    h = ts.span_hashes(buf, s, e)
    digits = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(_DIGIT[buf], out=digits[1:])
    h[digits[e] > digits[s]] = _FIELD
    line_at = np.unique(np.concatenate([offs[:-1][offs[:-1] < offs[1:]], np.flatnonzero(buf == 10) + 1]))
    line_at = line_at[line_at < len(buf)]
    bound = np.append(line_at, len(buf))
    first = np.searchsorted(s, bound)
    full = first[:-1] < first[1:]
    begin, end = bound[:-1][full], bound[1:][full]
    a, b = first[:-1][full], first[1:][full]
    line = ts.run_hashes(h, a, b)
    leaf = ts.mix64(ts.run_hashes(h, a, np.minimum(a + depth, b)) + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    doc = np.searchsorted(offs, begin, "right") - 1
    return doc, begin, end, leaf.view(np.int64), line.view(np.int64), b - a


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct line of each row, by its hashes."""
    for batch in batches:
        for lo, _, buf, offs in ts.text_chunks(batch.column(2)):
            doc, _, _, leaf, line, words = _lines(buf, offs)
            _, keep = np.unique(np.stack([doc, line], 1), axis=0, return_index=True) if len(doc) else (0, np.zeros(0, int))
            at = pa.array(doc[keep] + lo)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(leaf[keep]), pa.array(line[keep]), pa.array(words[keep].astype(np.int32))], ["id", "h", "leaf", "line", "words"])


def _emit_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines with their texts, each once per chunk of rows."""
    for batch in batches:
        for _, _, buf, offs in ts.text_chunks(batch.column(0)):
            _, begin, end, leaf, line, _ = _lines(buf, offs)
            line, keep = np.unique(line, return_index=True)
            raw = buf.tobytes()
            texts = pa.array([raw[a:b] for a, b in zip(begin[keep].tolist(), end[keep].tolist(), strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(leaf[keep]), pa.array(line), texts], ["leaf", "line", "text"])


def _masked(text: str = "text"):
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(w.rlike("[0-9]"), F.lit("<*>")).otherwise(w)), " ")


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has BROADCAST_ROWS rows at most; its rows are a few numbers each."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"))


def _parsed(rows: DataFrame) -> DataFrame:
    """One row per text and distinct line: id, h (hash of the text), leaf, line, words; lines are read once for all counts."""
    return cut(rows.mapInArrow(_emit, "id long, h long, leaf long, line long, words int"))


def line_templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """The lines of recurring templates: line (hash), pattern, occurrences (pairs of a line of the template and a document).

    A leaf of the tree has lines of one number of words and the same leading DEPTH words. In a leaf, a word is common at its
    place if the lines that hold it there have `min_docs` documents together. The template of a group of lines has at each
    place the common word that most documents of the group's lines have there, ties to the greater word; other places are
    fields. A line belongs to it if at least SIMILARITY of the line's words without digits are those of the template,
    which recurs if its lines have `min_docs` documents. The first group is the leaf as a whole; lines that do not
    belong to its template, or all if it does not recur, are tried with the groups of their anchors: the lines left that
    share one of their ANCHORS rarest or ANCHORS most common words at its place, ties by place. A line with `min_docs` documents recurs by
    itself.

    So what a line's templates are depends neither on the order of lines nor on how full a leaf is. Counts meet per word and
    place, never per leaf, and lines of a hot word, anchor or template are dealt over tasks; a line that all documents
    share is one row per task. A template with occurrences for `min_docs` documents, however many lines of the leaf one
    document holds, recurs for certain; documents are counted for the few others.
    """
    rows = _rows(docs, id_col, text_col)
    return _templates(rows, _parsed(rows), min_docs)


def _templates(rows: DataFrame, parsed: DataFrame, min_docs: int) -> DataFrame:
    of = parsed.select("leaf", "line", "id").distinct()
    leaves = cut(parsed.groupBy("leaf").agg(F.count("*").alias("c")).where(F.col("c") >= min_docs).select("leaf"))
    inside = of.join(_small(leaves), "leaf", "left_semi")
    docs_of_line = inside.groupBy("leaf", "line").agg(F.count("*").alias("docs"))
    texts = rows.select("text").mapInArrow(_emit_texts, "leaf long, line long, text string").join(_small(leaves), "leaf")
    texts = texts.groupBy("leaf", "line").agg(F.min("text").alias("text")).select("leaf", "line", _masked().alias("masked"))
    seen = cut(docs_of_line.join(texts, ["leaf", "line"]))
    # common words of the leaves, and the lines that could have enough of them
    words = seen.select("line", "docs", "leaf", F.posexplode(F.split("masked", " "))).where(f"pos >= {DEPTH} and col <> '<*>'").select("line", "docs", "pos", F.col("col").alias("word"), F.struct("leaf", "pos", "col").alias("key"))
    common = cut(words.groupBy("key").agg(F.sum("docs").alias("f"), F.count("*").alias("n")).where(F.col("f") >= min_docs))
    held = _common_words(seen, words, common)
    real = lambda ws: F.size(F.filter(ws, lambda w: w != "<*>"))
    lined = seen.join(held, "line", "left").withColumn("common", F.coalesce("common", F.array().cast(held.schema["common"].dataType)))
    lined = lined.withColumns({"own": real(F.split("masked", " ")), "lead": real(F.slice(F.split("masked", " "), 1, DEPTH))}).where(F.col("lead") + F.size("common") >= SIMILARITY * F.col("own") - 1e-9)
    lined = cut(lined.select("line", "docs", "masked", "leaf", "own", "lead", "common"))
    together = cut(inside.groupBy("leaf", "id").agg(F.count("*").alias("c")).groupBy("leaf").agg(F.max("c").alias("together")))
    at = lambda pos, word: F.struct(pos.alias("pos"), word.alias("word"))
    whole = F.array(at(F.lit(-1), F.lit("")))
    ends = F.concat(F.slice("common", 1, ANCHORS), F.slice("common", F.greatest(F.size("common") - ANCHORS + 1, F.lit(1)), ANCHORS))
    first = cut(_members(lined, whole, inside, seen, together, min_docs))
    rest = lined.join(first.select("line"), "line", "left_anti")
    second = _members(rest, F.array_distinct(F.transform(ends, lambda c: at(c["pos"], c["word"]))), inside, seen, together, min_docs)
    alone = seen.where(F.col("docs") >= min_docs).select("line", F.col("masked").alias("pattern"), F.col("docs").alias("occurrences"))
    return first.unionByName(second).unionByName(alone)


def _common_words(seen: DataFrame, words: DataFrame, common: DataFrame) -> DataFrame:
    """The common words of lines: line, common (f, pos, word in order); lines without any may lack.

    Keys of many lines, of which there can be four a partition at most, are broadcast as a list per leaf and place and are
    looked up within a line, so that no row is made for a word of theirs; the words of other keys are joined.
    """
    parts = max(int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    limit = max((common.agg(F.sum("n")).first()[0] or 0) // (4 * parts), 256)
    hot = common.where(F.col("n") > limit)
    entry = F.struct("f", "pos", "word")
    if hot.isEmpty():
        return words.join(common.select("key", "f"), "key").groupBy("line").agg(F.sort_array(F.collect_list(entry)).alias("common"))
    cold = words.join(F.broadcast(hot.select("key")), "key", "left_anti").join(common.select("key", "f"), "key").groupBy("line").agg(F.collect_list(entry).alias("cold"))
    places = hot.groupBy("key.leaf", "key.pos").agg(F.collect_list(F.struct("f", "key.pos", F.col("key.col").alias("word"))).alias("w"))
    places = places.groupBy("leaf").agg(F.map_from_entries(F.collect_list(F.struct("pos", "w"))).alias("m"), F.max("pos").alias("last"))
    places = places.select("leaf", F.transform(F.sequence(F.lit(0), "last"), lambda i: F.try_element_at(F.col("m"), i)).alias("hot"))
    here = F.transform(F.split("masked", " "), lambda w, i: F.filter(F.get("hot", i), lambda h: h["word"] == w))
    lines = seen.join(F.broadcast(places), "leaf").select("line", F.flatten(F.filter(here, lambda x: x.isNotNull())).alias("hot"))
    return lines.join(cold, "line", "full").select("line", F.sort_array(F.concat(*[F.coalesce(c, F.array().cast(lines.schema["hot"].dataType)) for c in ("hot", "cold")])).alias("common"))


def _members(lined: DataFrame, anchors: Column, inside: DataFrame, seen: DataFrame, together: DataFrame, min_docs: int) -> DataFrame:
    """Lines that belong to recurring templates of their anchors: line, pattern, occurrences."""
    tried = cut(lined.withColumn("key", F.explode(F.transform(anchors, lambda a: F.struct("leaf", a.alias("at"))))))
    votes = tried.select("key", "docs", F.explode("common").alias("c")).groupBy("key", F.col("c.pos").alias("pos"), F.col("c.word").alias("word")).agg(F.sum("docs").alias("n"))
    modes = votes.groupBy("key", "pos").agg(F.max_by("word", F.struct("n", "word")).alias("word"))
    modes = modes.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("pos", "word"))).alias("mode"))  # a line's places
    both = hot_join(tried, modes, cut(tried.groupBy("key").agg(F.count("*").alias("n"))), "key", "line", "left").withColumn("mode", F.coalesce("mode", F.create_map().cast("map<int,string>")))
    equal = F.size(F.filter("common", lambda c: F.coalesce(F.try_element_at(F.col("mode"), c["pos"]) == c["word"], F.lit(False))))
    pattern = F.array_join(F.transform(F.split("masked", " "), lambda w, i: F.when(i < DEPTH, w).otherwise(F.coalesce(F.try_element_at(F.col("mode"), i), F.lit("<*>")))), " ")
    members = cut(both.where(F.col("lead") + equal >= SIMILARITY * F.col("own") - 1e-9).select("line", "docs", "key", pattern.alias("pattern")))
    stats = members.groupBy("key").agg(F.sum("docs").alias("most"), F.count("*").alias("n"), F.min("pattern").alias("pattern")).where(F.col("most") >= min_docs)
    stats = stats.withColumn("leaf", F.col("key.leaf")).join(together, "leaf")
    stats = cut(stats.withColumn("sure", (F.col("n") == 1) | (F.col("most") >= min_docs * F.col("together"))).withColumn("template", F.monotonically_increasing_id()))
    joined = cut(hot_join(members.select("line", "key"), stats.select("key", "template", "sure"), stats.select("key", "n"), "key", "line"))
    # documents of the others, which have few: under min_docs for each line that a document holds
    unsure = joined.where("not sure").groupBy("line").agg(F.collect_list("template").alias("templates"))  # at most its anchors
    pairs = hot_join(inside.select("line", "id"), unsure, seen.select("line", F.col("docs").alias("n")), "line", "id")
    counted = pairs.select(F.explode("templates").alias("template"), "id").distinct().groupBy("template").agg(F.count("*").alias("c")).where(F.col("c") >= min_docs)
    good = stats.join(counted, "template", "left").where("sure or c is not null").select("template", "pattern", F.col("most").alias("occurrences"))
    found = hot_join(joined.select("line", "template"), cut(good), stats.select("template", "n"), "template", "line")
    return found.groupBy("line").agg(F.max(F.struct("occurrences", "pattern")).alias("b")).select("line", "b.pattern", "b.occurrences")


def long_lines(parsed: DataFrame) -> DataFrame:
    """Lines of many words that recur as they are, up to words with digits, in a few documents: line, and the least id of
    their documents."""
    enough = F.lit(None).cast("long")
    for words, least in sorted(LONG_LINES):
        enough = F.when(F.col("words") >= words, F.lit(least)).otherwise(enough)
    lines = parsed.where(F.col("words") >= min(w for w, _ in LONG_LINES)).select("line", "words", "id").distinct()
    lines = lines.groupBy("line", "words").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return lines.where(F.col("n") >= enough).select("line", "first")


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, gone = batch.column(2), batch.column(3)
        for lo, hi, buf, offs in ts.text_chunks(texts):
            doc, begin, end, _, line, _ = _lines(buf, offs)
            raw, cuts = buf.tobytes(), np.searchsorted(doc, np.arange(hi - lo + 1))
            clean, n_lines, n_dropped = [], [], []
            for d in range(hi - lo):
                at, own = slice(cuts[d], cuts[d + 1]), gone[lo + d].as_py()
                n_lines.append(cuts[d + 1] - cuts[d])
                hit = np.isin(line[at], own) if own else np.zeros(n_lines[-1], bool)
                n_dropped.append(int(hit.sum()))
                out, pos = [], int(offs[d])
                for a, b in zip(begin[at][hit].tolist(), end[at][hit].tolist(), strict=True):
                    out.append(raw[pos:a])
                    pos = b
                clean.append((b"".join(out) + raw[pos : offs[d + 1]]).decode() if texts[lo + d].is_valid else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(clean, pa.string())], ["id", "n_lines", "n_dropped", "clean_text"])


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """Per document: id, n_lines (with a word), n_dropped, clean_text (other bytes stay as they are).

    Lines whose template recurs in at least `min_docs` documents are dropped everywhere. A long line recurs as itself in
    fewer documents (LONG_LINES: from 50 words on in two, from 8 words on in three); as it may be prose, the document with
    the least id keeps it.

    Defined cases: null text stays null with 0 lines; blank lines are kept and not counted; rows that share an id are one
    document in counts, null ids together one, and each row is cleaned on its own; a line repeated within one
    document counts one document; an empty table gives an empty result; other columns are not looked at.
    """
    rows = _rows(docs, id_col, text_col)
    parsed = _parsed(rows)
    recurring = _templates(rows, parsed, min_docs).select("line").distinct().withColumn("first", F.lit(None).cast("long"))
    recurring = cut(recurring.union(long_lines(parsed)).groupBy("line").agg((F.count("*") > F.count("first")).alias("everywhere"), F.min("first").alias("first")))
    # the least id keeps a long line; with null ids alone, no one does
    lines = parsed.select("id", "h", "line")
    few = recurring.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = lines.join(F.broadcast(recurring), "line") if few else hot_join(lines, recurring, cut(lines.groupBy("line").agg(F.count("*").alias("n"))), "line", "h")
    occurs = met.where("everywhere or not (id <=> first) or first is null")
    # by id and text: the lists of a text hold its own lines at most, however many rows share an id or have none
    gone = cut(occurs.groupBy("id", "h").agg(F.collect_set("line").alias("gone")).withColumnsRenamed({"id": "_id", "h": "_h"}))
    out = rows.join(gone, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left").select("id", "h", "text", "gone")
    return out.mapInArrow(_drop, "id long, n_lines long, n_dropped long, clean_text string").withColumnRenamed("id", id_col)
