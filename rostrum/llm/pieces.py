"""SentencePiece encoding and decoding (byte-pair model with byte fallback) by vectorised merge rounds.

Texts are cut into words where no piece of the vocabulary can reach across: before a space mark that follows
another character, and around line ends.  The words that a worker has not seen lie in one flat numpy array
of symbols.  In each round every adjacent pair is looked up in the sorted table of merges, a segmented minimum
gives each word its best rank, all leftmost pairs of that rank that do not overlap are merged at once, the array is
compacted, and words without a pair leave.  The library is asked for the vocabulary only.

Merging a word's pairs of one rank at once is what the one-by-one rule (best score, then leftmost) does, unless a merged
piece could at once be part of a pair as good as its own; in those words one pair is merged a round.  A word
that is not done after ``ROUNDS`` rounds (thousands of characters without a space) goes on one pair at a time from a heap,
in time n log n; the rule depends on the present symbols only, so the result is the same.  Such a word is held whole, at
some 150 bytes a character.

Long texts are encoded stretch by stretch, cut at word ends, so memory follows the ids and not the words.

Edge cases: a null text is empty, and an empty text is begin and end id alone; characters outside the
vocabulary become bytes; the space mark in a text decodes to a space, as in the library; names of special pieces
in a text are ordinary text; a null list of ids decodes to the empty text; equal rows give equal rows; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import codecs
import heapq
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenizing
from .tokenizing import WordStore, slices

MODEL = "piece_bpe_32k.model"
#: The mark that stands for a space (fixed value).
MARK = "▁"
#: Rounds after which a word is finished from a heap.
ROUNDS = 256
#: Characters of a stretch.
STRETCH = 1 << 20
_NONE = np.iinfo(np.int32).max


class Merges:
    """The merges of a model: pairs of symbols, their ranks and what they become.

    Symbols are piece ids, then characters that occur in pieces without being one (from ``n_ids``), then
    all other characters (``n_symbols`` plus code point).
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.vocab_size())
        self.n_ids = len(ids)
        self.begin, self.end, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.byte_ids = np.full(256, self.unknown, np.int64)
        self.bytes_of = [b""] * self.n_ids
        plain = {}
        for i in ids:
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                plain[piece] = i
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
        symbol = dict(plain)
        for c in sorted({c for p in plain for c in p} - set(plain)):
            symbol[c] = len(ids) + len(symbol) - len(plain)
        self.n_symbols = len(ids) + len(symbol) - len(plain)
        self.letters = {v: k for k, v in symbol.items() if v >= self.n_ids}
        scores = np.array([sp.get_score(i) for i in ids])
        ranks = np.unique(-scores, return_inverse=True)[1]  # the best score is rank 0; equal scores are equal ranks
        table = {}
        for piece, i in plain.items():
            for k in range(1, len(piece)):
                a, b = symbol.get(piece[:k]), symbol.get(piece[k:])
                if a is not None and b is not None:
                    table[a * self.n_symbols + b] = i
        self.keys = np.array(sorted(table), np.int64)
        self.to = np.array([table[k] for k in self.keys.tolist()], np.int64)
        self.rank = ranks[self.to].astype(np.int32)
        self.table = table
        self.rank_of = ranks
        # Ranks whose piece can take part in a pair of the same or a better rank.
        best = np.full(self.n_symbols, _NONE, np.int64)
        for part in (self.keys // self.n_symbols, self.keys % self.n_symbols):
            np.minimum.at(best, part, self.rank)
        self.alone = np.zeros(len(scores) + 1, bool)
        self.alone[ranks[self.to][best[self.to] <= ranks[self.to]]] = True
        self.first = np.full(0x110000, -1, np.int32)
        for c, i in symbol.items():
            if len(c) == 1:
                self.first[ord(c)] = i
        self._check_cuts(plain)

    def _check_cuts(self, plain: dict[str, int]) -> None:
        """Words may be cut before a mark behind another character, and around characters no merge has."""
        if any(b == MARK != a for p in plain for a, b in pairwise(p)):
            raise ValueError("a piece has a space mark behind another character")
        joined = {c for p in plain if len(p) > 1 for c in p}
        lone = "".join(c for c in "\n\r\t" if c not in joined)
        one = f"|[{lone}]" if lone else ""
        self.words = re.compile(f"{MARK}*[^{MARK}{lone}]+|{MARK}+{one}")
        self.cut = re.compile(f"(?<=[^{MARK}])(?={MARK})" + (f"|(?<=[{lone}])" if lone else ""))

    def lookup(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of pairs; rank ``_NONE`` where there is no merge."""
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE), self.to[at]

    def merge(self, words: list[str], rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all words in a row, number of symbols of each word)."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        sym = self.first[points].astype(np.int64)
        sym = np.where(sym < 0, self.n_symbols + points, sym)
        seg = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym) and rounds:
            rounds -= 1
            known = (seg[:-1] == seg[1:]) & (sym[:-1] < self.n_symbols) & (sym[1:] < self.n_symbols)
            rank, to = np.full(len(sym), _NONE, np.int32), np.zeros(len(sym), np.int64)
            at = np.flatnonzero(known)
            rank[at], to[at] = self.lookup(sym[at] * self.n_symbols + sym[at + 1])
            starts = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            sizes = np.diff(np.append(starts, len(sym)))
            best = np.minimum.reduceat(rank, starts)
            rest = np.repeat(best != _NONE, sizes)
            if not rest.all():
                done.append((sym[~rest], seg[~rest]))
            pick = np.flatnonzero((rank == np.repeat(best, sizes)) & rest)
            # Of pairs in a row every second one, from the left; of words that merge one pair the first.
            new_run = np.concatenate([[True], np.diff(pick) != 1]) if len(pick) else np.zeros(0, bool)
            run = pick[new_run][np.cumsum(new_run) - 1] if len(pick) else pick
            take = (pick - run) % 2 == 0
            new_word = np.concatenate([[True], np.diff(seg[pick]) != 0]) if len(pick) else new_run
            pick = pick[take & (new_word | ~self.alone[rank[pick]])]
            sym[pick] = to[pick]
            rest[pick + 1] = False
            sym, seg = sym[rest], seg[rest]
        if len(sym):  # long words
            edges = np.flatnonzero(np.diff(seg)) + 1
            for s, w in zip(np.split(sym, edges), np.split(seg, edges), strict=True):
                left = self.finish(s.tolist())
                done.append((np.array(left, np.int64), np.full(len(left), w[0])))
        sym, seg = (np.concatenate([d[i] for d in done]) if done else np.zeros(0, np.int64) for i in (0, 1))
        order = np.argsort(seg, kind="stable")
        return sym[order], np.bincount(seg, minlength=len(words))

    def finish(self, sym: list[int]) -> list[int]:
        """Merge one word's pairs one by one, best rank first, then leftmost."""
        n, k = len(sym), self.n_symbols
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and sym[i] < k and sym[j] < k and (m := self.table.get(sym[i] * k + sym[j])) is not None:
                heap.append((int(self.rank_of[m]), i, sym[i], sym[j]))

        for i in range(n - 1):
            push(i)
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i] = self.table[a * k + b]
            sym[j] = -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            size = len(heap)
            for p in (before[i], i):
                if p >= 0:
                    push(p)
            new = heap[size:]
            del heap[size:]
            for x in new:
                heapq.heappush(heap, x)
        return [s for s in sym if s >= 0]

    def ids(self, sym: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of symbols: characters that are no piece become their bytes."""
        odd = sym >= self.n_ids
        if not odd.any():
            return n, sym.astype(np.uint32)
        kinds, which = np.unique(sym[odd], return_inverse=True)
        raw = [(self.letters.get(s) or chr(s - self.n_symbols)).encode() for s in kinds.tolist()]
        length = np.ones(len(sym), np.int64)
        length[odd] = np.array([len(r) for r in raw])[which]
        ends = np.cumsum(length)
        out = np.repeat(sym, length)
        at = np.repeat(ends[odd] - length[odd], length[odd])
        step = np.flatnonzero(np.repeat(odd, length)) - at
        wide = np.zeros((len(raw), 4), np.int64)
        for i, r in enumerate(raw):
            wide[i, : len(r)] = self.byte_ids[list(r)]
        out[np.repeat(odd, length)] = wide[np.repeat(which, length[odd]), step]
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])]
        return np.diff(edges), out.astype(np.uint32)


class PieceStore(WordStore):
    """Ids by word, filled by merge rounds."""

    def __init__(self, path: str, limit: int = 800_000):
        self.merges, self.limit = Merges(path), limit
        self._reset()

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        n, flat = self.merges.ids(*self.merges.merge(chunks))
        return n.astype(np.int32), flat

    def stretches(self, text: str, size: int = STRETCH):
        """``text`` in parts of about ``size`` characters that end where words end."""
        at = 0
        while at < len(text):
            cut = self.merges.cut.search(text, at + size) if at + size < len(text) else None
            end = cut.start() if cut else len(text)
            yield text[at:end]
            at = end

    def encode_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, begin and end ids included; number of ids of each)."""
        inner, n, words, counts, held = [], np.full(len(texts), 2, np.int64), [], [], 0

        def flush():
            ids, k = self._gather(pa.array(words, pa.large_string()), np.array([c for _, c in counts], np.int64))
            np.add.at(n, np.array([i for i, _ in counts], np.int64), k)
            inner.append(ids)
            words.clear()
            counts.clear()

        for i, t in enumerate(texts):
            for part in self.stretches((MARK + t).replace(" ", MARK)) if t else ():
                found = self.merges.words.findall(part)
                words += found
                counts.append((i, len(found)))
                held += len(part)
                if held >= STRETCH:
                    flush()
                    held = 0
        if counts:
            flush()
        ends = np.cumsum(n)
        out = np.full(int(n.sum()), self.merges.begin, np.uint32)
        own = np.ones(len(out), bool)
        out[ends - 1] = self.merges.end
        own[ends - 1] = own[ends - n] = False
        out[own] = np.concatenate(inner) if inner else []
        return out, n

    def decode(self, ids: np.ndarray, n: np.ndarray) -> list[str]:
        """Texts of lists of ids: marks are spaces, the first one is dropped, broken bytes become U+FFFD each."""
        if not hasattr(self, "_lengths"):
            self._lengths = np.array([len(b) for b in self.merges.bytes_of], np.int64)
            self._starts = np.cumsum(self._lengths) - self._lengths
            self._flat = np.frombuffer(b"".join(self.merges.bytes_of), np.uint8)
            self._spaced = np.array([b.startswith(b" ") and len(b) > 0 for b in self.merges.bytes_of])
            self._spaced[self.merges.byte_ids] = False
        ids = ids.astype(np.int64)
        size = self._lengths[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = self._flat[np.repeat(self._starts[ids] - (ends - size), size) + np.arange(total)].tobytes()
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])]
        # The mark that encoding put before the text: that of the first id which is not begin or end.
        control = np.isin(ids, (self.merges.begin, self.merges.end))
        out, a = [], 0
        for k, x, y in zip(n.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = np.flatnonzero(~control[a : a + k])
            text = memoryview(flat)[x + int(len(own) > 0 and self._spaced[ids[a + own[0]]]) : y]
            if len(own) and own[-1] - own[0] >= len(own):  # begin or end ids inside end a run of bytes
                size_ = np.cumsum(size[a + own])[np.flatnonzero(np.diff(own) > 1)] - (y - x - len(text))
                parts = np.split(np.frombuffer(text, np.uint8), size_)
                out.append("".join(p.tobytes().decode("utf-8", "rostrum-each") for p in parts))
            else:
                out.append(str(text, "utf-8", "rostrum-each"))
            a += k
        return out


codecs.register_error("rostrum-each", lambda e: ("�" * (e.end - e.start), e.end))

_stores: dict[str, PieceStore] = {}


def store(model: str) -> PieceStore:
    """This worker's store; Spark reuses Python workers, so later tasks find it filled."""
    path = tokenizing.tokenizer_path(model)
    if path not in _stores:
        _stores[path] = PieceStore(path)
    return _stores[path]


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), with begin and end ids."""

    def run(batches):
        st = store(model)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, n = st.encode_texts(part.column("text").to_pylist())
                edges = np.concatenate([[0], np.cumsum(n) * 4]).astype(np.int64)
                blob = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(edges), pa.py_buffer(ids.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), blob.cast(pa.binary())], names=["doc_id", "n_tokens", "ids"])

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cols.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids, text: the text of each list of ids."""

    def run(batches):
        st = store(model)
        for batch in batches:
            for part in slices(batch, "ids"):
                lists = [np.frombuffer(b or b"", "<u4") for b in part.column("ids").to_pylist()]
                n = np.array([len(x) for x in lists], np.int64)
                text = st.decode(np.concatenate(lists) if len(lists) else np.zeros(0, np.uint32), n)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string())], names=["doc_id", "n_tokens", "ids", "text"])

    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, text string")


def digest(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Encode all documents, decode their ids, and return digests of both."""
    return decode(encode(docs, model), model).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    )
