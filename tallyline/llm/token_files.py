"""Token ids as Arrow stream files of fixed-size-list batches, and the way back."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import encoder
from .cluster import cut, running_sums

#: Sequences in one record batch.
BATCH_SEQUENCES = 256
END_ID = 0


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder that every task can reach."""
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


class _SequenceWriter:
    """Packs ids into sequences of one length, and these into batches of BATCH_SEQUENCES; only a file's last batch may hold
    fewer. The mask is false where the last sequence is padded."""

    def __init__(self, sink, seq_len: int, dtype: np.dtype):
        self.seq_len, self.dtype = seq_len, dtype
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.held, self.size = [], 0

    def add(self, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) > np.iinfo(self.dtype).max:
            raise OverflowError(f"id {int(ids.max())} does not fit into {self.dtype}")
        self.held.append(ids.astype(self.dtype))
        self.size += len(ids)
        full = BATCH_SEQUENCES * self.seq_len
        if self.size >= full:
            self._flush(self.size // full * full)

    def _flush(self, n: int, pad: int = 0) -> None:
        flat = np.concatenate([*self.held, np.zeros(pad, self.dtype)])
        mask = np.arange(n + pad) < n
        for at in range(0, n + pad, BATCH_SEQUENCES * self.seq_len):
            end = min(at + BATCH_SEQUENCES * self.seq_len, n + pad)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x[at:end]), self.seq_len) for x in (flat, mask)]
            self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.held, self.size = [flat[n + pad :]], self.size - n

    def close(self) -> None:
        if self.size:
            self._flush(self.size, -self.size % self.seq_len)
        self.out.close()


def _write(path: str, tokenizer: str, seq_len: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, folder = open_store(path)
        attempt = uuid.uuid4().hex
        names = [f"{folder}/{kind}-{part:06d}.arrow" for kind in ("tokens", "index")]
        temps = [f"{n}.{attempt}.tmp" for n in names]
        docs = total = 0
        index = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64())])
        with store.open_output_stream(temps[0]) as sink, store.open_output_stream(temps[1]) as index_sink:
            writer, table = _SequenceWriter(sink, seq_len, np.dtype(dtype)), pa.ipc.new_stream(index_sink, index)
            for batch in batches:
                for lo, hi, ids, offs in encoder(tokenizer).encode(batch.column(1)):
                    ids = np.insert(ids, offs[1:], END_ID)
                    writer.add(ids)
                    table.write_batch(pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offs) + 1)], schema=index))
                    docs, total = docs + hi - lo, total + len(ids)
            writer.close()
            table.close()
        for temp, name in zip(temps, names, strict=True):
            store.move(temp, name)  # a task that runs again puts the same bytes in place
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([docs], pa.int64()), pa.array([total], pa.int64())], ["part", "n_docs", "n_tokens"])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", seq_len: int = 2048, dtype: str = "uint16") -> DataFrame:
    """Encode every whole text, append the end id 0, and write the ids in ascending order of id under `path`.

    Range partitions keep that order over the files: each task writes tokens-<part>.arrow, an Arrow stream of batches
    with columns ids and mask, both fixed-size lists of seq_len, and index-<part>.arrow with (id, n_tokens) of
    each text. Equal-length sequences lie at fixed offsets in a batch, so a memory map gives any of them without a
    copy (sequence_at); documents run on over sequences, and only a file's last sequence is padded (mask false). An id
    beyond dtype raises OverflowError. Returns the materialised manifest: part, n_docs, n_tokens.

    Defined cases: null text counts as empty and yields the end id alone; null ids come first; rows with equal ids stay
    together, ordered by a hash of their text; an empty table writes no text. Extra columns are ignored.
    """
    store, folder = open_store(path)
    store.create_dir(folder, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # the hash also parts texts of one id, or of none, over tasks
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(rows.mapInArrow(_write(path, tokenizer, seq_len, dtype), "part int, n_docs long, n_tokens long"))


def _read(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_store(path)
        for part in (p for b in batches for p in b.column(0).to_pylist()):
            with store.open_input_file(f"{folder}/index-{part:06d}.arrow") as f, store.open_input_file(f"{folder}/tokens-{part:06d}.arrow") as g:
                stream = (b.column(0).flatten().to_numpy(zero_copy_only=True) for b in pa.ipc.open_stream(g))
                held, start = np.zeros(0, np.uint16), 0
                for docs in pa.ipc.open_stream(f):
                    sizes = docs.column(1).to_numpy()
                    crcs, starts = [], []
                    for n in sizes.tolist():
                        pieces, missing = [], n
                        while missing:
                            if not len(held):
                                held = next(stream)
                            pieces.append(held[:missing])
                            held, missing = held[missing:], missing - len(pieces[-1])
                        crc = 0
                        for p in pieces:
                            crc = zlib.crc32(p.astype("<u4").tobytes(), crc)
                        crcs.append(crc)
                        starts.append(start)
                        start += n
                    yield pa.RecordBatch.from_arrays([pa.array([part] * len(sizes), pa.int32()), docs.column(0), pa.array(starts, pa.int64()), docs.column(1), pa.array(crcs, pa.int64())], ["part", "id", "start", "n_tokens", "ids_crc32"])

    return run


def read_token_digests(manifest: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document, from the files: id, start (ids of all documents before it), n_tokens, ids_crc32 (over
    its ids as little-endian unsigned 32-bit integers)."""
    ordered = running_sums(manifest, [F.col("part")], {"base": F.col("n_tokens")})
    # a task per file; without a number of partitions, adaptive execution would make one task of these few rows
    files = manifest.select("part").repartitionByRange(max(manifest.count(), 1), "part")
    rows = files.mapInArrow(_read(path), "part int, id long, start long, n_tokens long, ids_crc32 long")
    # one row per file
    out = rows.join(F.broadcast(ordered.select("part", "base")), "part")
    return out.select(F.col("id").alias(id_col), (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def read_sequences(spark: SparkSession, manifest: DataFrame, path: str) -> DataFrame:
    """The sequences themselves: part, position in the file, ids and mask as arrays. An empty manifest gives no
    rows; a document without text is its end id; files hold no other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_store(path)
        for part in (p for b in batches for p in b.column(0).to_pylist()):
            with store.open_input_file(f"{folder}/tokens-{part:06d}.arrow") as g:
                at = 0
                for b in pa.ipc.open_stream(g):
                    ids = b.column(0).cast(pa.list_(pa.int32(), b.column(0).type.list_size)).cast(pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array([part] * len(b), pa.int32()), pa.array(range(at, at + len(b)), pa.int64()), ids, b.column(1).cast(pa.list_(pa.bool_()))], ["part", "position", "ids", "mask"])
                    at += len(b)

    return manifest.select("part").mapInArrow(run, "part int, position long, ids array<int>, mask array<boolean>")


def sequence_at(raw: bytes | memoryview, position: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of one sequence of a token file's bytes (such as a memory map); the ids are a view of them.

    All batches before the last are of one size, so the sequence's batch is found by its offset; no other is read.
    """
    source = pa.BufferReader(pa.py_buffer(raw))
    schema = pa.ipc.read_schema(source)
    first = source.tell()
    if position < 0 or not (size := _batch_bytes(source)):
        raise IndexError("no such sequence")
    at = first + position // BATCH_SEQUENCES * size
    source.seek(min(at, source.size()))
    if not _batch_bytes(source):
        raise IndexError("no such sequence")
    source.seek(at)
    batch, row = pa.ipc.read_record_batch(pa.ipc.read_message(source), schema), position % BATCH_SEQUENCES
    if row >= len(batch):
        raise IndexError("no such sequence")
    ids, mask = batch.column(0)[row].values, batch.column(1)[row].values
    return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)


def _batch_bytes(source: pa.BufferReader) -> int:
    """Bytes of the message at the reader's position, 0 at the end of the stream."""
    begin = source.tell()
    try:
        pa.ipc.read_message(source)
    except (EOFError, pa.ArrowInvalid):
        return 0
    return source.tell() - begin
