"""Fast exact encoding with a byte-level BPE file of the tokenizers library, one Arrow batch at a time.

The library's pre-tokenizer cuts a text into pieces that are encoded on their own. Pieces repeat, so each worker
finds the cuts with array operations, has the library encode each distinct piece once, and looks the rest up by a
64-bit hash; what is found is then held against the piece byte by byte. Texts that hold anything but ASCII and two-byte
characters, a special token or a very long piece go to the library whole.
"""

from __future__ import annotations

import os
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa

from . import textspans as ts

_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
#: First code point that the array cutter leaves to the library.
_LIMIT = 0x280
#: Pieces that a worker remembers (some 50 MB); it then keeps those it has met in several chunks.
_MAX_PIECES = 1_000_000
#: Bytes of a piece that is remembered.
_LONG_PIECE = 256
#: New pieces that go to the library as one text, where the cuts between them are certain.
_JOINED = 500


def _classes() -> np.ndarray:
    out = np.zeros(_LIMIT, np.uint8)
    for c in range(_LIMIT):
        kind = unicodedata.category(chr(c))[0]
        out[c] = {"L": _LETTER, "N": _NUMBER}.get(kind, _OTHER)
    out[[9, 10, 11, 12, 13, 32]] = _SPACE
    return out


_CLASS = _classes()


def _suffixes(buf: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Length of the English contraction suffix after an apostrophe at each position, 0 if none."""
    pad = np.concatenate([buf, np.zeros(2, np.uint8)])
    one, two = pad[at + 1], pad[at + 2]
    one = np.where(at + 1 < end, one, 0)
    two = np.where(at + 2 < end, two, 0)
    out = np.zeros(len(at), np.int64)
    for pair in ("re", "ve", "ll"):
        out[(one == ord(pair[0])) & (two == ord(pair[1]))] = 2
    for c in "stmd":
        out[one == ord(c)] = 1
    return out


def piece_starts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Mask of the first byte of each piece; documents hold only characters below _LIMIT."""
    n = len(buf)
    cls = _CLASS[buf]
    lead = np.flatnonzero(buf >= 0xC2)
    if len(lead):
        cp = ((buf[lead].astype(np.int32) & 0x1F) << 6) | (buf[np.minimum(lead + 1, n - 1)] & 0x3F)
        cls[lead] = cls[np.minimum(lead + 1, n - 1)] = _CLASS[np.minimum(cp, _LIMIT - 1)]
    start = np.ones(n, bool)
    start[1:] = cls[1:] != cls[:-1]
    full = offs[:-1] < offs[1:]
    begin = offs[:-1][full]
    start[begin] = True
    doc_begin = np.zeros(n + 1, bool)
    doc_begin[begin] = True
    doc_begin[n] = True
    # the last of a run of white space goes its own way unless the text ends there; a blank joins what follows
    space = np.flatnonzero(cls == _SPACE)
    space = space[~doc_begin[space + 1]]
    final = space[cls[space + 1] != _SPACE]
    start[final] = True
    start[final[buf[final] == 32] + 1] = False
    quote = np.flatnonzero((buf == 39) & start)
    if len(quote):
        end = offs[1:][np.searchsorted(offs, quote, "right") - 1]
        size = _suffixes(buf, quote, end)
        quote, size, end = quote[size > 0], size[size > 0], end[size > 0]
        start[quote + 1] = False
        after = quote + 1 + size
        start[after[after < end]] = True
    return start


class ByteBpe:
    """Encoder of one worker: the library's tokenizer and the pieces seen so far."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a byte-level token has a character per byte
        self.bytes_of[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.limit = _MAX_PIECES
        self._keep(None)

    def _keep(self, kept: np.ndarray | None) -> None:
        """Forget all pieces but those numbered in `kept`."""
        if kept is None:
            self.keys, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int32)
            self.sizes, self.spans, self.met = (np.zeros(0, np.int32) for _ in range(3))
            self.flat, self.raw = np.zeros(0, np.uint32), np.zeros(0, np.uint8)
        else:
            number = np.full(len(self.sizes), -1, np.int32)
            number[kept] = np.arange(len(kept))
            self.flat = self.flat[np.repeat(np.isin(np.arange(len(self.sizes)), kept), self.sizes)]
            self.raw = self.raw[np.repeat(np.isin(np.arange(len(self.spans)), kept), self.spans)]
            self.sizes, self.spans, self.met = self.sizes[kept], self.spans[kept], self.met[kept] * 0
            there = number[self.order] >= 0
            self.keys, self.order = self.keys[there], number[self.order[there]]
        self._index()

    def _index(self) -> None:
        self.firsts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        self.begins = np.cumsum(self.spans, dtype=np.int64) - self.spans
        self.eight = ts.octets(self.raw)

    def _coded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _join_coded(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and sizes of pieces that each begin with a blank and go on with something else: laid end to end they are
        cut apart again, so the library gets many as one text. None if its tokens do not end where the pieces end."""
        bits = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        coded = self._coded([b"".join(bits[i : i + _JOINED]).decode() for i in range(0, len(bits), _JOINED)])
        ids = np.fromiter(chain.from_iterable(coded), np.uint32)
        reach = np.cumsum(self.bytes_of[ids])
        want = np.cumsum(ends - starts)
        at = np.searchsorted(reach, want)
        if at[-1] != len(reach) - 1 or (reach[at] != want).any():
            return None
        return ids, np.diff(at, prepend=-1)

    def _learn(self, keys: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw, n = buf.tobytes(), ends - starts
        after = buf[np.minimum(starts + 1, len(buf) - 1)]
        blank = (buf[starts] == 32) & (n > 1) & ~ts.SPACE[after]
        joined = self._join_coded(raw, starts[blank], ends[blank]) if blank.any() else None
        order = np.concatenate([np.flatnonzero(blank), np.flatnonzero(~blank)]) if joined else np.arange(len(keys))
        rest = order[int(blank.sum()) if joined else 0 :]
        coded = self._coded([raw[a:b].decode() for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)])
        flat, sizes = [np.fromiter(chain.from_iterable(coded), np.uint32)], [np.fromiter(map(len, coded), np.int32, len(coded))]
        if joined:
            flat, sizes = [joined[0], *flat], [joined[1].astype(np.int32), *sizes]
        old = len(self.sizes)
        self.flat, self.sizes = np.concatenate([self.flat, *flat]), np.concatenate([self.sizes, *sizes])
        self.spans = np.concatenate([self.spans, n[order].astype(np.int32)])
        self.met = np.concatenate([self.met, np.zeros(len(order), np.int32)])
        self.raw = np.concatenate([self.raw, *[np.frombuffer(b"".join(raw[a:b] for a, b in zip(starts[order].tolist(), ends[order].tolist(), strict=True)), np.uint8)]])
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(old, old + len(order))
        at = np.searchsorted(self.keys, keys)
        self.keys, self.order = np.insert(self.keys, at, keys), np.insert(self.order, at, number)
        self._index()

    def _slots(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each piece, and which pieces differ from the remembered bytes of their hash."""
        keys, first, inverse = np.unique(ts.span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        new = self.keys[np.minimum(at, len(self.keys) - 1)] != keys if len(self.keys) else np.ones(len(keys), bool)
        if len(self.keys) + new.sum() > self.limit:
            kept = np.flatnonzero(self.met > 1)
            self._keep(kept if 2 * len(kept) < self.limit else None)
            at = np.searchsorted(self.keys, keys)
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            self._learn(keys[new], buf, starts[first[new]], ends[first[new]])
            at = np.searchsorted(self.keys, keys)
        found = self.order[at]
        self.met[found] += 1
        slots, n = found[inverse], ends - starts
        wrong = self.spans[slots] != n
        own, left, done = ts.octets(buf), np.flatnonzero(~wrong & (n > 8)), 0
        while len(left):  # up to eight bytes the hash is one to one for a length
            mask = ts.MASKS[np.minimum(n[left] - done, 8)]
            wrong[left] |= ((own[starts[left] + done] ^ self.eight[self.begins[slots[left]] + done]) & mask) != 0
            done += 8
            left = left[n[left] > done]
        return slots, wrong

    def _plain(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Documents that piece_starts() can cut."""
        odd = np.flatnonzero(buf >= 0xCA)
        c2 = np.flatnonzero(buf == 0xC2)
        c2 = c2[np.isin(buf[np.minimum(c2 + 1, len(buf) - 1)], (0x85, 0xA0))]
        out = np.ones(len(offs) - 1, bool)
        for at in (odd, c2):
            out[np.searchsorted(offs, at, "right") - 1] = False
        raw = buf.tobytes()
        for special in self.specials:
            at = raw.find(special)
            while at >= 0:
                out[np.searchsorted(offs, at, "right") - 1] = False
                at = raw.find(special, at + 1)
        return out

    def encode(self, texts: pa.Array, counts_only: bool = False):
        """Yield (first row, end row, ids, id offsets) per chunk of rows; ids is None with counts_only."""
        for lo, hi, buf, offs in ts.text_chunks(texts):
            text, text_offs, plain = buf, offs, self._plain(buf, offs)
            while True:
                if not plain.all():
                    buf = text[np.repeat(plain, np.diff(text_offs))]
                    offs = np.concatenate([[0], np.cumsum(np.where(plain, np.diff(text_offs), 0))])
                starts = np.flatnonzero(piece_starts(buf, offs)) if len(buf) else np.zeros(0, np.int64)
                ends = np.append(starts[1:], len(buf)) if len(starts) else starts
                slots, wrong = np.zeros(0, np.int32), ends - starts > _LONG_PIECE
                if len(starts) and not wrong.any():
                    slots, wrong = self._slots(buf, starts, ends)
                if not wrong.any():
                    break
                plain[np.searchsorted(offs, starts[wrong], "right") - 1] = False
            rows = np.flatnonzero(~plain)
            raw = [text[text_offs[r] : text_offs[r + 1]].tobytes().decode() for r in rows]
            whole = {int(r): np.array(c, np.uint32) for r, c in zip(rows, self._coded(raw) if raw else [], strict=True)}
            sizes = self.sizes[slots]
            ends_of = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            id_offs = ends_of[np.searchsorted(starts, offs)]
            if counts_only:
                n = np.diff(id_offs)
                for r, ids in whole.items():
                    n[r] = len(ids)
                yield lo, hi, None, np.concatenate([[0], np.cumsum(n)])
                continue
            where = np.repeat(self.firsts[slots] - ends_of[:-1], sizes) + np.arange(ends_of[-1])
            ids = self.flat[where] if len(where) else np.zeros(0, np.uint32)
            if whole:
                parts = [whole.get(r, ids[id_offs[r] : id_offs[r + 1]]) for r in range(hi - lo)]
                ids = np.concatenate(parts)
                id_offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            yield lo, hi, ids, id_offs


_ENCODERS: dict[str, ByteBpe] = {}


def encoder(path: str) -> ByteBpe:
    """This worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteBpe(path)
    return _ENCODERS[path]
