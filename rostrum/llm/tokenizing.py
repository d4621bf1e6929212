"""Tokenisation by the ``tokenizers`` library, once per distinct word of a worker.

Both vocabularies split text at white space before they merge, so the ids of a text are the ids of
its white-space chunks in a row.  Chunks repeat far more often than they differ: a worker encodes
each chunk it has not seen with ``tokenizers`` and gathers all other ids from a bounded store,
with numpy.  The store is keyed by two independent 64-bit hashes of the chunk.  When it is full it
keeps the chunks met again since it last was, or starts anew where these are most of it, so memory
does not grow with the input.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode White_Space, as the tokenizers' patterns read ``\\s`` (fixed values).
WS = "\t-\r \x85\xa0  -     　"
_ODD = re.compile(f"^[{WS}]|[{WS}]$|[{WS}] | [{WS}]")
_SPACED = re.compile(f" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
#: A chunk that others of its kind may follow and go before in one text: one space, at its start, no white space at its end.
_JOINS = re.compile(f" [^{WS}](?:[^ ]*[^{WS}])?")
#: Chunks encoded at once, and those joined to one text: most of the library's time for a short text is not spent on merges.
BATCH, JOINED = 8192, 32
_KEYS = ("rostrum-word-one", "rostrum-word-two")


class WordStore:
    """Ids by chunk. ``spaced``: chunks carry the one space before them (byte-level BPE)."""

    def __init__(self, path: str, spaced: bool, limit: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self.spaced, self.limit = spaced, limit
        if spaced:
            vocab = self.tok.get_vocab()
            self.begins = np.zeros(max(vocab.values()) + 1, bool)
            self.begins[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True  # the vocabulary's sign for a space
        self._reset()

    def _reset(self) -> None:
        self.k1 = np.empty(0, np.uint64)
        self.k2 = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int64)
        self.n = np.empty(0, np.int32)
        self.ids = np.empty(0, np.uint32)
        self.used = np.empty(0, bool)  # met again since the store was last full

    def _keep_used(self) -> None:
        keep = np.flatnonzero(self.used)
        self.k1, self.k2, n = self.k1[keep], self.k2[keep], self.n[keep]
        ends = np.cumsum(n, dtype=np.int64)
        self.ids = self.ids[np.repeat(self.at[keep] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        self.at, self.n, self.used = ends - n, n, np.zeros(len(keep), bool)

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each chunk, and the ids in a row."""
        joins = np.fromiter((self.spaced and _JOINS.fullmatch(c) is not None for c in chunks), bool, len(chunks))
        if not joins.any():
            return self._encode_each(chunks)
        together, alone = ([c for c, j in zip(chunks, joins.tolist(), strict=True) if j is kind] for kind in (True, False))
        n1, flat1 = self._encode_joined(together)
        if not alone:
            return n1, flat1
        n2, flat2 = self._encode_each(alone)
        n, at = np.empty(len(chunks), np.int32), np.empty(len(chunks), np.int64)
        n[joins], n[~joins] = n1, n2
        at[joins] = np.cumsum(n1, dtype=np.int64) - n1
        at[~joins] = len(flat1) + np.cumsum(n2, dtype=np.int64) - n2
        ends = np.cumsum(n, dtype=np.int64)
        return n, np.concatenate([flat1, flat2])[np.repeat(at - (ends - n), n) + np.arange(int(ends[-1]))]

    def _encode_joined(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For chunks that match ``_JOINS``: the pattern cuts before each one's space, which is the only one, so an id that begins with a space begins a chunk."""
        flat = [np.empty(0, np.uint32)]
        for at in range(0, len(chunks), BATCH):  # the library's results are a hundred times larger than the ids
            texts = ["".join(chunks[i : i + JOINED]) for i in range(at, min(at + BATCH, len(chunks)), JOINED)]
            flat += [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(flat)
        first = np.flatnonzero(self.begins[ids])
        if len(first) != len(chunks):  # another vocabulary, where a token may reach over a space
            return self._encode_each(chunks)
        return np.diff(first, append=len(ids)).astype(np.int32), ids

    def _encode_each(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        n, flat = [np.empty(0, np.int32)], [np.empty(0, np.uint32)]
        for at in range(0, len(chunks), BATCH):
            got = [e.ids for e in self.tok.encode_batch(chunks[at : at + BATCH], add_special_tokens=False)]
            n.append(np.fromiter(map(len, got), np.int32, len(got)))
            flat.append(np.fromiter(chain.from_iterable(got), np.uint32, int(n[-1].sum())))
        return np.concatenate(n), np.concatenate(flat)

    def lookup(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of each of these distinct chunks in ``self.ids``."""
        words = chunks.to_numpy(zero_copy_only=False)
        h1, h2 = (pd.util.hash_array(words, hash_key=k, categorize=False) for k in (_KEYS[0][:16], _KEYS[1][:16]))
        order = np.argsort(h1)
        h1, h2 = h1[order], h2[order]  # looked up in order, which is several times faster
        pos = np.searchsorted(self.k1, h1)
        safe = np.minimum(pos, max(0, len(self.k1) - 1))
        known = (self.k1[safe] == h1) & (self.k2[safe] == h2) if len(self.k1) else np.zeros(len(h1), bool)
        self.used[pos[known]] = True
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.k1) + len(new) > self.limit:
                if np.count_nonzero(self.used) + len(new) <= self.limit * 3 // 4:
                    self._keep_used()
                else:
                    self._reset()
                    new = np.arange(len(words))
            n, flat = self._encode([words[i] for i in order[new]])
            at = len(self.ids) + np.concatenate([[0], np.cumsum(n[:-1], dtype=np.int64)])
            k1 = np.concatenate([self.k1, h1[new]])
            by = np.argsort(k1, kind="stable")
            self.k1, self.k2 = k1[by], np.concatenate([self.k2, h2[new]])[by]
            self.at, self.n = np.concatenate([self.at, at])[by], np.concatenate([self.n, n])[by]
            self.used = np.concatenate([self.used, np.zeros(len(new), bool)])[by]
            self.ids = np.concatenate([self.ids, flat])
            pos = np.searchsorted(self.k1, h1)
            same = self.k2[np.minimum(pos, len(self.k1) - 1)] == h2
            for i in np.flatnonzero(~same):  # two chunks with one first key
                j = pos[i]
                while self.k2[j] != h2[i]:
                    j += 1
                pos[i] = j
        back = np.empty(len(pos), np.int64)
        back[order] = pos
        return self.at[back], self.n[back]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each); null texts count as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        if self.spaced:
            return self._encode_spaced(texts)
        lists = pc.ascii_split_whitespace(texts)
        return self._gather(lists.values if lists.offset == 0 else lists.flatten(), np.diff(lists.offsets.to_numpy()))

    def _encode_spaced(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, _RE2_ODD).to_numpy(zero_copy_only=False)
        plain = pa.array(~odd)
        lists = pc.split_pattern(texts.filter(plain), " ")
        lists = lists.cast(pa.list_(pa.large_string())) if pa.types.is_list(lists.type) else lists.cast(pa.large_list(pa.large_string()))
        counts = np.zeros(len(texts), np.int64)
        counts[~odd] = np.diff(lists.offsets.to_numpy())
        pieces = lists.flatten()
        first = np.zeros(len(pieces), bool)
        first[lists.offsets.to_numpy()[:-1][np.diff(lists.offsets.to_numpy()) > 0]] = True
        # A chunk that follows a space gets it back, each distinct one once; "first" chunks of a text have none.
        after = pieces.filter(pa.array(~first)).dictionary_encode()
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), after.dictionary, pa.scalar("", pa.large_string()))
        cut = [_SPACED.findall(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        counts[odd] = [len(c) for c in cut]
        rest = pa.concat_arrays([pieces.filter(pa.array(first)), pa.array([c for x in cut for c in x], pa.large_string())]).dictionary_encode()
        others = len(spaced) + rest.indices.to_numpy().astype(np.int64)
        where, marks = np.empty(int(counts.sum()), np.int64), np.repeat(odd, counts)
        plain_at = np.empty(len(pieces), np.int64)
        plain_at[~first], plain_at[first] = after.indices.to_numpy(), others[: first.sum()]
        where[~marks], where[marks] = plain_at, others[first.sum() :]
        return self._gather_distinct(pa.concat_arrays([spaced, rest.dictionary]), where, counts)

    def _gather(self, chunks: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(chunks, pa.ChunkedArray):
            chunks = chunks.combine_chunks()
        if not len(chunks):
            return np.empty(0, np.uint32), np.zeros(len(counts), np.int64)
        d = chunks.dictionary_encode()
        return self._gather_distinct(d.dictionary, d.indices.to_numpy(zero_copy_only=False), counts)

    def _gather_distinct(self, chunks: pa.Array, idx: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of ``chunks`` at the places ``idx``."""
        if not len(idx):
            return np.empty(0, np.uint32), np.zeros(len(counts), np.int64)
        at, n = self.lookup(chunks)
        lens = n[idx].astype(np.int64)
        ends = np.cumsum(lens)
        total = int(ends[-1])
        src = np.repeat(at[idx] - (ends - lens), lens) + np.arange(total)
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return self.ids[src], np.diff(edges)


#: The same as _ODD for Arrow's regular expressions (also texts that begin or end with white space).
_RE2_ODD = _ODD.pattern

_stores: dict[tuple, WordStore] = {}


def store(path: str, spaced: bool) -> WordStore:
    """This worker's store; Spark reuses Python workers, so later tasks find it filled."""
    key = (path, spaced)
    if key not in _stores:
        _stores[key] = WordStore(path, spaced)
    return _stores[key]


def slices(batch: pa.RecordBatch, text: str, limit: int = 4 << 20):
    """Row ranges of a batch with about ``limit`` bytes of text each, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    cum, start = np.cumsum(size, dtype=np.int64), 0
    while start < len(size):
        before = cum[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(cum, before + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def tokenizer_path(name: str) -> str:
    """Where the worker finds a public vocabulary; the files are never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)
