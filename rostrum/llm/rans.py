"""Static range asymmetric numeral system over token ids, vectorised over interleaved lanes.

One shared table of symbol frequencies codes every block.  Token i of a block belongs to lane
i % lanes; all lanes step together and write to one stream of 32-bit words, so a block is decoded
by the same few numpy operations per step.  A frame is self-contained: header, document directory,
lane states, checkpoints (states and stream place every ``every`` steps, where a decoder can start
in the middle or several can share a block), words, and a CRC-32 of all that.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"RRANS1\0\0"
_HEAD = struct.Struct("<8sIIIQQIIQ")  # magic, bits, lanes, docs, tokens, first token, checkpoints, every, words
LOW = np.uint64(1 << 31)
_LOW32 = np.uint64((1 << 32) - 1)


class Table:
    """Frequencies scaled to 2**bits; every symbol that occurs keeps at least one slot."""

    def __init__(self, freq: np.ndarray, bits: int):
        self.bits, self.freq = bits, freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.crc = zlib.crc32(self.freq.astype("<u4").tobytes())
        self._slot: np.ndarray | None = None

    @property
    def slot(self) -> np.ndarray:
        if self._slot is None:
            self._slot = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slot

    @classmethod
    def fit(cls, counts: np.ndarray, bits: int = 20) -> Table:
        counts = np.asarray(counts, np.int64)
        size = 1 << bits
        if np.count_nonzero(counts) > size:
            raise ValueError("more symbols than slots")
        if not counts.sum():
            counts = np.ones(1, np.int64)
        exact = counts / counts.sum() * size
        freq = np.where(counts > 0, np.maximum(1, np.floor(exact)), 0).astype(np.int64)
        over = int(freq.sum()) - size
        while over > 0:  # take from the most frequent, never below one slot
            order = np.argsort(-freq, kind="stable")
            take = np.minimum(np.maximum(freq[order] - 1, 0), np.maximum(1, freq[order] * over // freq.sum()))
            take = np.where(np.cumsum(take) <= over, take, np.maximum(0, over - (np.cumsum(take) - take)))
            freq[order] -= take
            over = int(freq.sum()) - size
        freq[np.argmax(freq)] -= over
        return cls(freq, bits)


def encode(ids: np.ndarray, docs: np.ndarray, sizes: np.ndarray, first: int, table: Table, lanes: int = 1024, every: int = 256) -> bytes:
    """A frame with ``ids``: the tokens of ``docs`` (``sizes`` each); ``first``: tokens before it in its part."""
    n = len(ids)
    steps = -(-n // lanes)
    x = np.full(lanes, LOW, np.uint64)
    top = np.uint64(63 - table.bits)
    half, size = np.uint64(32), np.uint64(1 << table.bits)
    pair = (table.freq << half) | table.cum  # one look-up a token for both
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    written = 0
    for t in range(steps - 1, -1, -1):
        sym = ids[t * lanes : (t + 1) * lanes]
        k = len(sym)
        both, y = pair.take(sym), x[:k]
        f = both >> half
        full = np.flatnonzero((y >> top) >= f)
        if len(full):
            w = y.take(full)
            words.append(w.astype(np.uint32))
            written += len(w)
            y[full] = w >> half
        # (q << bits) + (y - q * f) + cum, where y are the first lanes of x
        y += (y // f) * (size - f)
        y += both & _LOW32
        if t and t % every == 0:
            marks.append((written, x.copy()))
    stream = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
    marks.reverse()
    body = [
        _HEAD.pack(MAGIC, table.bits, lanes, len(docs), n, first, len(marks), every, len(stream)),
        struct.pack("<I", table.crc),
        docs.astype("<i8").tobytes(),
        sizes.astype("<i8").tobytes(),
        x.astype("<u8").tobytes(),
        np.array([len(stream) - w for w, _ in marks], "<u8").tobytes(),
        *(s.astype("<u8").tobytes() for _, s in marks),
        stream.astype("<u4").tobytes(),
    ]
    out = b"".join(body)
    return out + struct.pack("<I", zlib.crc32(out))


class Frame:
    """A frame read back; raises ``ValueError`` where checksum, magic or table do not fit."""

    def __init__(self, data: bytes, table: Table):
        if len(data) < _HEAD.size + 8 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("frame checksum")
        magic, bits, self.lanes, docs, self.n, self.first, marks, self.every, words = _HEAD.unpack_from(data)
        (crc,) = struct.unpack_from("<I", data, _HEAD.size)
        if magic != MAGIC or bits != table.bits or crc != table.crc:
            raise ValueError("frame made with another table or format")
        self.table, at = table, _HEAD.size + 4

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            a = np.frombuffer(data, kind, n, at)
            at += a.nbytes
            return a

        self.docs, self.sizes = take("<i8", docs), take("<i8", docs)
        self.states = take("<u8", self.lanes)
        self.places = take("<u8", marks)
        self.marks = take("<u8", marks * self.lanes).reshape(marks, self.lanes)
        self.words = take("<u4", words)

    def decode(self, section: int | None = None) -> np.ndarray:
        """All ids, or those from checkpoint ``section`` (0: the start) to the next one."""
        if section is None:
            return np.concatenate([self.decode(k) for k in range(len(self.marks) + 1)])
        x = (self.marks[section - 1] if section else self.states).astype(np.uint64)  # a copy
        at = int(self.places[section - 1]) if section else 0
        steps = -(-self.n // self.lanes)
        begin, end = section * self.every, min(steps, (section + 1) * self.every) if section < len(self.marks) else steps
        out = np.empty(max(0, min(self.n, end * self.lanes) - begin * self.lanes), np.uint32)
        bits, mask, half = np.uint64(self.table.bits), np.uint64((1 << self.table.bits) - 1), np.uint64(32)
        slot, words = self.table.slot, self.words
        pair = (self.table.freq << half) | self.table.cum  # one look-up a token for both
        for t in range(begin, end):
            k = min(self.lanes, self.n - t * self.lanes)
            y = x[:k]
            low = y & mask
            sym = slot.take(low.view(np.int64))
            both = pair.take(sym)
            y >>= bits  # in place: y are the first lanes of x
            y *= both >> half
            y += low
            y -= both & _LOW32
            need = np.flatnonzero(y < LOW)
            if len(need):
                y[need] = (y.take(need) << half) | words[at : at + len(need)]
                at += len(need)
            out[(t - begin) * self.lanes : (t - begin) * self.lanes + k] = sym
        return out
