"""Near-duplicate detection with circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textspans as ts
from .cluster import cut, hot_join

_U32 = np.uint32
#: Rows up to which a table of pairs is broadcast (about 40 MB); beyond it the texts are shuffled instead.
BROADCAST_ROWS = 400_000
#: Members of a bucket whose pairs one task looks at.
BUCKET = 8192
#: Texts of one block in the verification of a group; a task holds two blocks.
GROUP = 200
#: Share of equal signature coordinates from which a pair is verified.
AGREE = 0.6


def circulant_minhash(values: np.ndarray, offs: np.ndarray, n_coords: int) -> np.ndarray:
    """Signature matrix (coordinate, set) of non-empty sets of 64-bit values.

    Two permutations serve all coordinates: sigma scatters the values over 0 .. 2^32 - 1, and coordinate k is the least
    pi(sigma(v) + k mod 2^32), that is pi shifted circularly by k.
    """
    base = (ts.mix64(values ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(_U32)
    out = np.empty((n_coords, len(offs) - 1), _U32)
    x, t = np.empty_like(base), np.empty_like(base)
    for k in range(n_coords):
        np.add(base, _U32(k), out=x)
        for shift, mul in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
            np.right_shift(x, _U32(shift), out=t)
            np.bitwise_xor(x, t, out=x)
            if mul != 1:
                np.multiply(x, _U32(mul), out=x)
        out[k] = np.minimum.reduceat(x, offs[:-1])
    return out


def _band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """(set, band) keys; the band number is part of the key."""
    bands = sig.shape[0] // rows
    acc = np.zeros((bands, sig.shape[1]), np.uint64)
    for r in range(rows):
        acc = ts.mix64(acc * np.uint64(0x9FB21C651E98DF25) + sig[r::rows][:bands].astype(np.uint64))
    acc = ts.mix64(acc + np.arange(1, bands + 1, dtype=np.uint64)[:, None] * np.uint64(0xD1342543DE82EF95))
    return acc.T.view(np.int64)


def _sign(shingle_words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in ts.text_chunks(batch.column(1)):
                sets = ts.shingle_sets(buf, offs, shingle_words)
                n = np.array([len(s) for s in sets], np.int64)
                keys, coords = np.zeros((len(sets), bands), np.int64), np.zeros((len(sets), bands * rows), np.uint8)
                if full := [s for s in sets if len(s)]:
                    flat = np.concatenate(full)
                    cuts = np.concatenate([[0], np.cumsum(n[n > 0])])
                    sig = circulant_minhash(flat, cuts, bands * rows)
                    keys[n > 0], coords[n > 0] = _band_keys(sig, rows), sig.T.astype(np.uint8)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), keys.ravel())
                own = batch.column(0).slice(lo, hi - lo).to_pylist()  # empty sets have no digest in common
                digest = pa.array([hashlib.blake2b(s.data, digest_size=16).digest() if len(s) else str(i).encode() for i, s in zip(own, sets, strict=True)], pa.binary())
                low = pa.array([row.tobytes() for row in coords], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), digest, lists, low], ["id", "n", "digest", "bands", "sig"])

    return run


def _compare(shingle_words: int, percent: int):
    """Rows come sorted: for each (a, salt) first a's own text (b null), then the texts to hold against it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for batch in batches:
            a, salt, b = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found = []
            for lo, _, buf, offs in ts.text_chunks(batch.column(3)):
                for i, s in enumerate(ts.shingle_sets(buf, offs, shingle_words), lo):
                    if (a[i], salt[i]) != at:
                        at, own = (a[i], salt[i]), []
                    if b[i] is None:
                        own.append(s)
                        continue
                    for o in own:
                        both = len(np.intersect1d(o, s, assume_unique=True))
                        if len(s) and 100 * both >= percent * (len(o) + len(s) - both):
                            found.append((a[i], b[i]))
                            break
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["u", "v"])

    return run


def confirm(pairs: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity, as edges (u, v).

    The text of b travels once per pair, that of a once per about 200 pairs of a, so a hub is spread over many groups.
    `pairs` must be materialised; its row count decides between a broadcast and a shuffle join with the texts.
    """
    spark = pairs.sparkSession
    n = pairs.count()
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / 200).cast("int").alias("parts"))
    salted = pairs.join(hubs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"), "b")
    left = hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"))
    wanted = salted.union(left).withColumn("id", F.coalesce("b", "a"))
    if n <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    rows = texts.join(wanted, "id").select("a", "salt", "b", "text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_compare(shingle_words, percent), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components as (id, component), component being the least id; ids without an edge are absent.

    Alternating large-star and small-star steps on the edge table; minima are partial aggregates, so hubs do not
    gather. A step ends in a checkpoint; only an edge count and checksum come to the driver.
    """
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        seen = state
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def _ratio(a: str, b: str, percent: int):
    """Sets of such sizes can reach the similarity."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the edges, so that no more edges than nodes leave a task."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for x, y in zip(u.tolist(), v.tolist(), strict=True):
        a, b = find(x), find(y)
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append((x, y))
    return [x for x, _ in kept], [y for _, y in kept]


def _alike(percent: int):
    """Rows come sorted by bucket: key, id, n, label, sig. Emits a spanning forest of the bucket's pairs that have different
    labels, fitting sizes and enough equal signature coordinates; pairs within the largest label are not looked at."""

    def bucket(ids: np.ndarray, n: np.ndarray, label: np.ndarray, sig: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        names, inverse, counts = np.unique(label, return_inverse=True, return_counts=True)
        main = inverse == counts.argmax()
        least = AGREE * sig.shape[1]
        for i in np.flatnonzero(~main):
            fit = 100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])
            at = np.flatnonzero(fit & (inverse != inverse[i]) & (main | (ids > ids[i])))
            at = at[(sig[at] == sig[i]).sum(1) >= least] if len(at) else at
            if len(at):
                yield np.minimum(ids[at], ids[i]), np.maximum(ids[at], ids[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key, ids, n, label = (table.column(i).to_numpy() for i in range(4))
            sig = np.frombuffer(b"".join(table.column(4).to_pylist()), np.uint8).reshape(len(ids), -1)
            cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            found = [p for a, b in zip(cuts[:-1], cuts[1:], strict=True) for p in bucket(ids[a:b], n[a:b], label[a:b], sig[a:b])]
            u = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
            v = np.concatenate([y for _, y in found]) if found else np.zeros(0, np.int64)
            u, v = _forest(u, v)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            key = batch.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if last:  # all buckets but the last are complete
                yield from settle(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held and sum(map(len, held)):
            yield from settle(pa.Table.from_batches(held))

    return run


def _open_links(members: DataFrame, classes: DataFrame, percent: int, split: bool = True) -> DataFrame:
    """Edges (u, v) that span the pairs of open buckets, those with several labels, whose signatures agree in at least AGREE.

    A pair of similarity 0.8 falls below AGREE with probability 1e-8. Pairs are looked at within the task that holds the
    bucket, and only a forest that spans the alike ones leaves it. A bucket of more than BUCKET members, such as of texts
    that share one common passage, is split once by its members' other bands: links of 0.8 share 13 of 32 bands on average,
    and lack a second common one with probability 1e-6. What is still larger is dealt into blocks, and a task holds two.
    """
    sizes = cut(members.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key", "n"))
    opened = cut(hot_join(members, sizes.withColumnRenamed("n", "m"), sizes, "key", "id"))
    parts = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    wide = opened.where(F.col("m") > BUCKET)
    listed = opened.where(F.col("m") <= BUCKET).select("key", "id", "n", "label")
    if not split and not wide.isEmpty():
        blocks = F.ceil(F.col("m") * 2 / BUCKET).cast("int")
        dealt = wide.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        listed = listed.union(dealt.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "id", "n", "label"))
    rows = listed.join(classes.select("id", "n", "sig"), ["id", "n"]).select("key", "id", "n", "label", "sig")
    pairs = rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_alike(percent), "u long, v long").distinct()
    if not split or wide.isEmpty():
        return pairs
    deeper = wide.join(classes.select("id", "n", F.explode("bands").alias("other")), ["id", "n"]).where("key <> other")
    deeper = deeper.select(F.xxhash64(F.least("key", "other"), F.greatest("key", "other")).alias("key"), "id", "n", "label").distinct()
    return pairs.union(_open_links(deeper, classes, percent, split=False)).distinct()


def _verify_block(shingle_words: int, percent: int):
    """Rows come sorted by (grp, bi, bj): id, label, block, text. Verifies the pairs of different labels between both blocks
    (within one if they are the same) on full sets, and emits a spanning forest of the links."""

    def links(ids: list[int], labels: list[int], blocks: list[int], sets: list[np.ndarray], same: bool):
        n = np.array([len(x) for x in sets])
        at = np.repeat(np.arange(len(sets)), n)
        _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        number = np.cumsum(count > 1) - 1  # shingles of one text alone are in no intersection
        shared = count[inverse] > 1
        at, col = at[shared], number[inverse[shared]]
        both = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(col, kind="stable")
        at, col = at[order], col[order]
        for low in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
            part = slice(*np.searchsorted(col, (low, low + 4096)))
            m = np.zeros((len(sets), 4096), np.float32)
            m[at[part], col[part] - low] = 1
            both += m @ m.T
        lab, blk, both = np.array(labels), np.array(blocks), both.round().astype(np.int64)
        hit = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (lab[:, None] != lab[None, :])
        if not same:
            hit &= blk[:, None] != blk[None, :]
        x, y = np.nonzero(np.triu(hit, 1))
        u = np.array(ids)
        return _forest(u[x], u[y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [], [], [])

        def settle():
            u, v = links(*held, at[1] == at[2]) if len(held[0]) > 1 else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            grp, bi, bj, ids, labels, blocks = (batch.column(i).to_pylist() for i in range(6))
            for lo, _, buf, offs in ts.text_chunks(batch.column(6)):
                for i, s in enumerate(ts.shingle_sets(buf, offs, shingle_words), lo):
                    if (grp[i], bi[i], bj[i]) != at:
                        if at:
                            yield settle()
                        at, held = (grp[i], bi[i], bj[i]), ([], [], [], [])
                    for where, what in zip(held, (ids[i], labels[i], blocks[i], s), strict=True):
                        where.append(what)
        if at:
            yield settle()

    return run


def confirm_groups(links: DataFrame, labels: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Edges (u, v) that span all links between different labels inside the components of `links`.

    Members of a component are dealt into blocks of about GROUP; a task holds two blocks, so each text travels once per
    block of its component and no pair is listed.
    """
    groups = cut(components(links))
    blocks = groups.groupBy("component").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("nb"))
    own = groups.join(blocks, "component").join(labels.withColumnRenamed("component", "label"), "id", "left")
    own = own.select("id", F.col("component").alias("grp"), F.coalesce("label", "id").alias("label"), "nb", F.pmod(F.xxhash64("id"), "nb").cast("int").alias("block"))
    wanted = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    wanted = cut(wanted.select("id", "grp", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "label", "block"))
    few = wanted.count() <= BROADCAST_ROWS
    rows = texts.join(F.broadcast(wanted) if few else wanted, "id").select("grp", "bi", "bj", "id", "label", "block", "text")
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.repartition(parts, "grp", "bi", "bj").sortWithinPartitions("grp", "bi", "bj", "id")
    return rows.mapInArrow(_verify_block(shingle_words, percent), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, percent: int = 80, bands: int = 32, rows: int = 4) -> DataFrame:
    """One row per document: id column, n_shingles, component_id, kept.

    A-Z are lower-cased; a document's set holds its distinct shingles of `shingle_words` words, the whole sequence if
    it has fewer. Documents are linked if 100 * intersection >= percent * union, on full sets; component_id is the
    least id that links reach. With 32 bands of 4 coordinates a link at exactly 0.8 is missed with probability 5e-8.

    Equal sets, by a 128-bit BLAKE2b digest of all shingle hashes, form one class before any pair is looked at. In each bucket every class is first held against the
    bucket's least id; what is then still apart in a bucket is compared by signature inside the bucket's task, and
    the groups of alike texts are verified block by block. Pairs already joined are left out, and no list of pairs leaves
    a task, so groups of thousands of copies cost one comparison per member and bucket representative.

    Defined cases: null, empty or blank text has n_shingles 0, its own id as component and is kept. Rows with a null
    id link with nothing: component_id null, kept. Rows that share an id are one node. Repeated rows and ties give
    equal results per row; an empty table gives an empty result; other columns are not looked at.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sig = cut(source.mapInArrow(_sign(shingle_words, bands, rows), "id long, n long, digest binary, bands array<long>, sig binary"))
    classes = cut(sig.where("n > 0 and id is not null").groupBy("digest", "n").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.count("*").alias("copies")))
    buckets = classes.select("id", "n", F.explode("bands").alias("key"))
    shared = cut(buckets.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("id", "n")).alias("rep")).where("c > 1"))
    members = cut(hot_join(buckets, shared.select("key", "rep"), shared.select("key", F.col("c").alias("n")), "key", "id"))
    pairs = cut(members.where((F.col("id") != F.col("rep.id")) & _ratio("n", "rep.n", percent)).select(F.col("rep.id").alias("a"), F.col("id").alias("b")).distinct())
    edges = cut(confirm(pairs, source, shingle_words, percent))
    labels = components(edges)
    marked = members.select("key", "id", "n").join(labels, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("label"))
    more = cut(_open_links(marked, classes, percent))
    if not more.isEmpty():
        labels = components(edges.union(confirm_groups(more, labels, source, shingle_words, percent)))
    by_class = classes.select("digest", "id").join(labels, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    out = hot_join(sig.select("id", "n", "digest"), by_class, classes.select("digest", F.col("copies").alias("n")), "digest", "id", "left")
    comp = F.when(F.col("id").isNull(), None).when(F.col("n") == 0, F.col("id")).otherwise(F.col("component"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
