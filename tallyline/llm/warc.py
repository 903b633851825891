"""WARC archives: writing with payload revisits, and reading by boundary-chain verification."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import cut, hot_join, shared_dir
from .token_files import open_store

#: Bytes of an archive that one reading task scans.
SPLIT_BYTES = 8 << 20
#: Bytes that a reading task takes at first beyond its split for the last header; it reads on where that is too short.
HEADER_BYTES = 1 << 16
#: Groups of equal payloads up to which their table is broadcast (some 20 MB at about 100 bytes a row).
BROADCAST_ROWS = 200_000
_BLANK = b"\r\n\r\n"
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d+)[ \t]*(?=\r\n)", re.IGNORECASE)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(kind: str, page_id: int | None, url: str | None, body: bytes, digest: str, refers: int | None) -> bytes:
    name = lambda i: uuid.uuid5(uuid.NAMESPACE_URL, f"page:{i}")
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = http if kind == "revisit" else http + body
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name(page_id)}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}"] if url is not None else []
    lines += [f"WARC-Payload-Digest: sha1:{b32}", f"X-Payload-Length: {len(body)}"]
    lines += [f"X-Page-Id: {page_id}"] if page_id is not None else []
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:uuid:{name(refers)}>", f"X-Refers-To-Page: {refers}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, folder = open_store(path)
        name = f"{folder}/pages-{part:06d}.warc"
        temp = f"{name}.{uuid.uuid4().hex}.tmp"
        n = size = 0
        with store.open_output_stream(temp) as out:
            for batch in batches:
                for page, url, html, digest, refers in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    raw = _record("response" if refers is None else "revisit", page, url, (html or "").encode(), digest, refers)
                    out.write(raw)
                    n, size = n + 1, size + len(raw)
        store.move(temp, name)  # a task that runs again puts the same bytes in place
        yield pa.RecordBatch.from_arrays([pa.array([f"pages-{part:06d}.warc"]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["file", "bytes", "n_records"])

    return run


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", revisit_bytes: int = 1000) -> DataFrame:
    """Write one record per row; returns the materialised manifest (file, bytes, n_records).

    Of the records with equal payloads of at least `revisit_bytes`, that with the largest id is the response and the
    others are revisits that refer to it and carry no payload. Payload groups are found by digest and length, with
    partial maxima, so a payload that a third of the pages share gathers nowhere; only groups of two or more are joined
    back.

    Defined cases: null bodies count as empty; null urls have no target line, control characters are escaped; rows with a null
    id are responses and no one refers to them; rows that share the largest id are all responses; an empty table
    writes no record. Extra columns are ignored.
    """
    store, folder = open_store(path)
    store.create_dir(folder, recursive=True)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(body_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    groups = rows.where(F.octet_length("html") >= revisit_bytes).where("page_id is not null").groupBy("digest", F.octet_length("html").alias("size")).agg(F.max("page_id").alias("main"), F.count("*").alias("c"))
    groups = cut(groups.where("c > 1").select("digest", "size", "main", F.col("c").alias("n")))
    rows = rows.withColumn("size", F.octet_length("html"))
    if groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(groups.drop("n")), ["digest", "size"], "left")
    else:
        large = F.col("size") >= revisit_bytes  # small payloads, such as empty ones, stay out of the shuffle
        met = hot_join(rows.where(large), groups.select("digest", "main", F.col("size").alias("own_size")), groups.select("digest", "n"), "digest", "page_id", "left")
        met = met.withColumn("main", F.when(F.col("own_size") == F.col("size"), F.col("main"))).drop("own_size")
        rows = met.unionByName(rows.where(~large).withColumn("main", F.lit(None).cast("long")))
    rows = rows.select("page_id", "url", "html", "digest", F.when(F.col("page_id") != F.col("main"), F.col("main")).alias("refers"))
    return cut(rows.mapInArrow(_write(path), "file string, bytes long, n_records long"))


def _candidates(path: str):
    """For each split: every offset that looks like a record, and the first offset past the split that its chain of
    successors leads to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_store(path)
        for batch in batches:
            for file, size, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                end = min(start + SPLIT_BYTES, size)
                with store.open_input_file(f"{folder}/{file}") as f:
                    raw = f.read_at(min(end + HEADER_BYTES, size) - start, start)
                    magic = [m for m in _MAGIC.finditer(raw) if m.start() < end - start]
                    while magic and start + len(raw) < size and raw.find(_BLANK, magic[-1].end() - 2) < 0:
                        raw += f.read_at(min(len(raw), size - start - len(raw)), start + len(raw))
                offs, nexts = [], []
                stop, length = -1, None
                for m in magic:
                    low = m.end() - 2
                    if stop < low:  # otherwise the blank line found before is the next one for this candidate, too
                        stop = raw.find(_BLANK, low)
                        if stop < 0:
                            break
                        length = _LENGTH.search(raw, low, stop + 2)
                    elif length and length.start() < low:
                        length = _LENGTH.search(raw, low, stop + 2)
                    if length:
                        offs.append(start + m.start())
                        nexts.append(start + stop + 4 + int(length[1]) + 4)
                at = np.array(offs, np.int64)
                to = np.array(nexts, np.int64)
                leave = to.copy()
                for i in range(len(at) - 1, -1, -1):  # successors lie behind, so one pass from the end resolves the split
                    if to[i] < end:
                        j = np.searchsorted(at, to[i])
                        leave[i] = leave[j] if j < len(at) and at[j] == to[i] else -1
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(at), pa.string()), pa.array([size] * len(at), pa.int64()), pa.array([start] * len(at), pa.int64()), pa.array(at), pa.array(to), pa.array(leave)], ["file", "bytes", "split", "at", "next", "leave"])

    return run


def _ends_at_size(files: DataFrame, nodes: DataFrame, reached: DataFrame) -> None:
    """Raise ValueError if the chain of a file does not end at the file's size."""
    whole = reached.select("file", "at").join(nodes.where("leave = bytes").select("file", "at"), ["file", "at"]).select("file")
    broken = [r.file for r in files.where("bytes > 0").select("file").join(whole, "file", "left_anti").limit(5).collect()]
    if broken:
        raise ValueError(f"record chain does not end at the size of the file: {', '.join(broken)}")


def record_chain(files: DataFrame, path: str) -> DataFrame:
    """The true entry offset of each split: (file, bytes, split, entry). `files` has file and bytes.

    A task per split links its candidates to their successors; over splits, pointers are doubled from offset 0 on, so
    a file of n splits takes log2(n) rounds. Offsets that no chain from the start of the file reaches are magic inside
    payloads and are left out. A file whose chain does not end at its size is damaged and raises ValueError.
    """
    splits = files.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(SPLIT_BYTES))).alias("start"))
    parts = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    nodes = cut(splits.repartition(parts, "file", "start").mapInArrow(_candidates(path), "file string, bytes long, split long, at long, next long, leave long"))
    entries = nodes.where("at = 0").select("file", "bytes", "at", "leave")
    if nodes.where("split > 0").isEmpty():
        _ends_at_size(files, nodes, entries)
        return entries.select("file", "bytes", F.lit(0).cast("long").alias("split"), F.col("at").alias("entry"))
    # one jump: from an offset to where its chain enters a later split
    jumps = cut(nodes.select("file", "at", "leave"))
    reached = cut(entries.select("file", "bytes", "at"))
    while True:
        hop = reached.join(jumps, ["file", "at"]).select("file", "bytes", F.col("leave").alias("at")).where("at >= 0 and at < bytes")
        grown = cut(reached.union(hop).distinct())
        if grown.count() == reached.count():
            break
        reached = grown
        ahead = jumps.select("file", F.col("at").alias("leave"), F.col("leave").alias("far"))
        # reached offsets are kept, so doubling loses none; pointers beyond the last record stay where they are
        jumps = cut(jumps.join(ahead, ["file", "leave"], "left").select("file", "at", F.coalesce("far", "leave").alias("leave")))
    _ends_at_size(files, nodes, reached)
    one = F.floor(F.col("at") / SPLIT_BYTES) * SPLIT_BYTES
    return reached.select("file", "bytes", one.cast("long").alias("split"), F.col("at").alias("entry"))


def _fields(header: bytes) -> dict[str, str]:
    """The named fields of a record header, by lower-case name; a line that begins with a blank goes on with the one
    before, the first of equal names counts, and bytes that are not UTF-8 are replaced."""
    out: dict[str, str] = {}
    name = None
    for line in header.decode(errors="replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out.setdefault(name, value.strip())
    return out


def _http_head(block: bytes) -> bytes:
    """The HTTP header of a block with its blank line; empty where there is none."""
    stop = block.find(_BLANK)
    return block[: stop + 4] if block.startswith(b"HTTP/") and stop >= 0 else b""


def _number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def _hex_digest(text: str | None) -> str | None:
    """The SHA-1 of a digest field in lower-case hex, which the field may hold in base 32 or 16; null for others."""
    kind, _, value = (text or "").partition(":")
    if kind.strip().lower() != "sha1":
        return None
    value = value.strip()
    try:
        return (base64.b32decode(value.upper()) if len(value) == 32 else bytes.fromhex(value)).hex()
    except ValueError:
        return None


def _records(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_store(path)
        for batch in batches:
            for file, size, split, entry in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                at, end, rows = entry, min(split + SPLIT_BYTES, size), []
                with store.open_input_file(f"{folder}/{file}") as f:
                    base, raw = at, b""
                    while at < end:
                        head, piece = at - base, 1 << 20
                        stop = raw.find(_BLANK, head)
                        while stop < 0:
                            if piece > 1 << 20 and at + len(raw) >= size:
                                raise ValueError(f"no end of the record header at {at} in {file}")
                            base, head, raw = at, 0, f.read_at(min(piece, size - at), at)
                            stop, piece = raw.find(_BLANK), 2 * piece
                        fields = _fields(raw[head:stop])
                        n = int(fields["content-length"])
                        if stop + 4 + n > len(raw):
                            base, raw = at, f.read_at(stop - head + 4 + n, at)
                            head, stop = 0, stop - head
                        block = raw[stop + 4 : stop + 4 + n]
                        kind = fields.get("warc-type")
                        body = block[len(_http_head(block)) :] if fields.get("content-type", "").startswith("application/http") else block
                        length, digest = len(body), hashlib.sha1(body).hexdigest()
                        if kind == "revisit":
                            body, length, digest = None, _number(fields.get("x-payload-length")), _hex_digest(fields.get("warc-payload-digest"))
                        page, refers = _number(fields.get("x-page-id")), _number(fields.get("x-refers-to-page"))
                        rows.append((file, at, kind, page, fields.get("warc-target-uri"), length, digest, refers, body))
                        at += stop - head + 4 + n + 4
                        if len(rows) >= 200 or at >= end:
                            yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r, strict=True)) for r in rows], schema=_SCHEMA)
                            rows = []

    return run


_SCHEMA = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
_DDL = "file string, offset long, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """The archives of a folder: file, bytes; listed by Spark, contents unread."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc").load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))


def read_warc(files: DataFrame, path: str) -> DataFrame:
    """All records that the chain of boundaries reaches: file, offset, record_type, page_id, url, payload_bytes,
    payload_digest (SHA-1, lower-case hex; recomputed but for revisits), refers_to, payload (null for revisits).

    Archives of other writers may hold any record types and fields: names are read in any case of letters, what only this
    module writes (page ids, payload lengths of revisits) is null where it is absent, and a record that is not HTTP has
    its whole block as payload.

    A split is read by one task in pieces; memory holds one record and a piece, and headers may have any length. Bytes
    that look like a record inside a payload are left out; a broken boundary raises ValueError. An empty archive gives
    no rows.
    """
    shared_dir(files.sparkSession)
    chain = record_chain(files, path)
    parts = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return chain.repartition(parts, "file", "split").mapInArrow(_records(path), _DDL)
