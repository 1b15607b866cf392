"""Byte-level BPE by array scans.

Pre-tokenisation has no regular expression: every code point of a batch gets a
class from a table, classes and their right neighbours give a symbol, and each
symbol is a transition function of a small automaton. The functions that can
arise by composition form a finite monoid, so a prefix of functions is one small
integer, and composing two is one table look-up; the scan over blocks of symbols
is associative and runs on whole arrays. Whether a symbol opens a piece follows
from the state before it.

Pieces go through a bounded cache. Those not in it are merged together: all
missed pieces of a batch are one padded matrix of token ids in which every row
merges its lowest-ranked pair in each round; long pieces use a heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sessionlake.llm import columns

# Code points of the Unicode property White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202, 8232, 8233, 8239, 8287, 12288]

# Letters and numbers that the regex library knows and the Unicode version of the tokenizer libraries does not.
NEWER = [(0x558, 0x558), (0x58b, 0x58c), (0x88f, 0x88f), (0xc5c, 0xc5c), (0xcdc, 0xcdc), (0x208f, 0x208f), (0x209d, 0x209f), (0xa7ce, 0xa7cf), (0xa7d2, 0xa7d2), (0xa7d4, 0xa7d4), (0xa7dd, 0xa7dd), (0xa7e2, 0xa7e2), (0xa7f1, 0xa7f1), (0xab6c, 0xab6d), (0x107bb, 0x107bf), (0x10940, 0x10959), (0x10ec5, 0x10ec7), (0x10ed9, 0x10eee), (0x11b0a, 0x11b0a), (0x11db0, 0x11ddb), (0x11de0, 0x11de9), (0x11df1, 0x11df1), (0x1246f, 0x1246f), (0x12475, 0x1247f), (0x12550, 0x12686), (0x16ea0, 0x16eb8), (0x16ebb, 0x16ed3), (0x16ff2, 0x16ff3), (0x16ff4, 0x16ff6), (0x187f8, 0x187ff), (0x18cd6, 0x18cda), (0x18d09, 0x18d20), (0x18d80, 0x18df2), (0x18e00, 0x19191), (0x191a0, 0x191d2), (0x1b123, 0x1b128), (0x1b168, 0x1b168), (0x1d6a6, 0x1d6a6), (0x1df1f, 0x1df24), (0x1df2b, 0x1df81), (0x1df90, 0x1df96), (0x1dfcd, 0x1dfff), (0x1e6c0, 0x1e6de), (0x1e6e0, 0x1e6e2), (0x1e6e4, 0x1e6e5), (0x1e6e7, 0x1e6ed), (0x1e6f0, 0x1e6f4), (0x1e6fe, 0x1e6ff), (0x2b73a, 0x2b73f), (0x2b81e, 0x2b81e), (0x2cea2, 0x2cead), (0x323b0, 0x33479), (0x3d000, 0x3fc3f)]

# The endings of the pattern that follow an apostrophe.
ENDINGS_1 = ["s", "t", "m", "d"]
ENDINGS_2 = ["re", "ve", "ll"]

LETTER, NUMBER, OTHER, WHITE, SPACE, APOSTROPHE, SEPARATOR = range(7)
# Symbols: a class, or what the right neighbours make of it.
(S_LETTER, S_NUMBER, S_OTHER, S_APOS_1, S_APOS_2, S_PREFIX, S_LAST_WHITE, S_WHITE, S_SEPARATOR) = range(9)
# States: what the open piece is after a symbol.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, AFTER_PREFIX, ENDING_1, ENDING_2 = range(8)

#: Pieces of more bytes than this are merged by a heap.
LONG_PIECE = 48
#: Pieces that the cache of a worker holds at most.
CACHE_PIECES = 300_000


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and opens[symbol, state]: the state after the symbol, and whether a piece starts at it."""
    after, opens = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for symbol, state in ((S_LETTER, IN_LETTERS), (S_NUMBER, IN_NUMBERS), (S_OTHER, IN_OTHERS), (S_APOS_1, ENDING_1), (S_APOS_2, ENDING_2), (S_PREFIX, AFTER_PREFIX), (S_LAST_WHITE, FRESH), (S_WHITE, IN_WHITE), (S_SEPARATOR, FRESH)):
        after[symbol] = state
    for symbol, same in ((S_LETTER, IN_LETTERS), (S_NUMBER, IN_NUMBERS), (S_OTHER, IN_OTHERS), (S_WHITE, IN_WHITE)):
        opens[symbol, same] = False
    for symbol in (S_LETTER, S_NUMBER, S_OTHER, S_APOS_1, S_APOS_2):
        opens[symbol, AFTER_PREFIX] = False
    for symbol in (S_APOS_1, S_APOS_2):  # inside a run of others, or after a space, it is a sign like any other
        after[symbol, [IN_OTHERS, AFTER_PREFIX]] = IN_OTHERS
        opens[symbol, IN_OTHERS] = False
    after[S_LETTER, [ENDING_1, ENDING_2]] = FRESH, ENDING_1
    opens[S_LETTER, [ENDING_1, ENDING_2]] = False
    return after, opens


def _monoid(generators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(functions, product, symbols): all compositions of the generators, the table of 'first f, then g', and the generators' places."""
    found = {tuple(range(generators.shape[1])): 0}
    todo = list(found)
    while todo:
        f = todo.pop()
        for g in generators:
            h = tuple(int(g[s]) for s in f)
            if h not in found:
                found[h] = len(found)
                todo.append(h)
    functions = np.array(list(found), np.uint8)
    product = np.array([[found[tuple(int(g[s]) for s in f)] for g in functions] for f in functions], np.uint8)
    return functions, product, np.array([found[tuple(map(int, g))] for g in generators], np.uint8)


def _classes() -> np.ndarray:
    """The class of each code point, by its general category."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for name, kind in (("L", LETTER), ("N", NUMBER)):
        for run in regex.finditer(rf"\p{{{name}}}+", every):
            first, last = ord(run[0][0]), ord(run[0][-1])
            table[first : last + 1] = kind
    for first, last in NEWER:
        table[first : last + 1] = OTHER
    table[WHITE_SPACE] = WHITE
    table[ord(" ")], table[ord("'")] = SPACE, APOSTROPHE
    return table


AFTER, OPENS = _transitions()
FUNCTIONS, PRODUCT, GENERATORS = _monoid(AFTER)
CLASSES = _classes()
BLOCK = 256


def _states_before(symbols: np.ndarray) -> np.ndarray:
    """The state before each symbol, from a fresh start, by an associative scan over blocks."""
    n, size = len(symbols), len(FUNCTIONS)
    flat = PRODUCT.ravel()
    rows = -(-n // BLOCK)
    padded = np.zeros(rows * BLOCK, np.uint8)
    padded[:n] = GENERATORS[symbols]
    by_step = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
    prefix = np.empty_like(by_step)  # the composition of a block's symbols before each step
    held = np.zeros(rows, np.uint8)
    for k in range(BLOCK):
        prefix[k] = held
        held = flat[held.astype(np.intp) * size + by_step[k]]
    total = held
    shift = 1
    while shift < rows:  # inclusive scan over the blocks
        ahead = total.copy()
        ahead[shift:] = flat[total[:-shift].astype(np.intp) * size + total[shift:]]
        total, shift = ahead, shift * 2
    start = np.zeros(rows, np.uint8)
    start[1:] = FUNCTIONS[total[:-1], FRESH]
    states = FUNCTIONS.ravel()[prefix.astype(np.intp) * 8 + start[None, :]]
    return states.T.reshape(-1)[:n]


def _symbols(points: np.ndarray) -> np.ndarray:
    """Symbols of code points; 0x110000 stands between texts."""
    classes = np.full(len(points) + 3, SEPARATOR, np.uint8)
    classes[:-3] = np.where(points < 0x110000, CLASSES[np.minimum(points, 0x10FFFF)], SEPARATOR)
    own, following = classes[:-3], classes[1:-2]
    symbols = np.array([S_LETTER, S_NUMBER, S_OTHER, S_WHITE, S_WHITE, S_OTHER, S_SEPARATOR], np.uint8)[own]
    dense = following <= OTHER
    dense |= following == APOSTROPHE
    symbols[(own == SPACE) & dense] = S_PREFIX
    symbols[(own == WHITE) & dense] = S_LAST_WHITE
    at = np.flatnonzero((own == APOSTROPHE) & (following == LETTER))
    if len(at):
        ends = np.zeros(len(points) + 3, np.uint32)
        ends[:-3] = points
        one, two = ends[at + 1], ends[at + 2]
        symbols[at[np.isin(one, [ord(x) for x in ENDINGS_1])]] = S_APOS_1
        for x in ENDINGS_2:
            symbols[at[(one == ord(x[0])) & (two == ord(x[1]))]] = S_APOS_2
    return symbols


def boundaries(texts: list[str]) -> tuple[str, list[int], list[int]]:
    """(all texts as one, starts of pieces and the end, index of each text's first piece and the number of pieces), in code points.

    """
    joined = "".join(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(lengths)
    parted = np.insert(points, ends, 0x110000) if len(texts) else points
    symbols = _symbols(parted)
    opens = OPENS.ravel()[symbols.astype(np.intp) * 8 + _states_before(symbols)]
    keep = np.ones(len(parted), bool)
    keep[ends + np.arange(len(texts))] = False  # separators
    starts = np.flatnonzero(opens[keep])
    first = np.searchsorted(starts, ends - lengths)
    return joined, np.append(starts, len(joined)).tolist(), np.append(first, len(starts)).tolist()


def pieces(text: str) -> list[str]:
    """The pieces of one text."""
    joined, starts, _ = boundaries([text])
    return [joined[a:b] for a, b in zip(starts, starts[1:])]


def token_bytes(vocab: dict[str, int]) -> dict[int, bytes]:
    """The bytes of each id of a vocabulary whose strings write bytes as printable characters."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    sign = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return {i: bytes(sign[c] for c in t) for t, i in vocab.items()}


class Vocabulary:
    """Ids of byte strings and the pairs that merge. whole: a piece that is a token itself is never merged from bytes."""

    def __init__(self, tokens: dict[int, bytes], pairs: dict[tuple[int, int], tuple[int, int]], whole: bool):
        self.tokens, self.whole = tokens, whole
        self.ids = {b: i for i, b in tokens.items()}
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        self.pairs = pairs
        keys = np.fromiter((a << 20 | b for a, b in pairs), np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.fromiter((r for r, _ in pairs.values()), np.int64, len(pairs))[order]
        self.merged = np.fromiter((m for _, m in pairs.values()), np.int64, len(pairs))[order]
        self.slots = self._hashed()
        self.cache: dict[str, bytes] = {}

    #: A power of two of slots; a key sits at the first free slot from its hash on.
    SLOT_BITS = 21

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)

    def _hashed(self) -> np.ndarray:
        slots = np.full(1 << self.SLOT_BITS, -1, np.int32)
        for k, h in enumerate(self._hash(self.keys).tolist()):
            while slots[h] >= 0:
                h = (h + 1) & ((1 << self.SLOT_BITS) - 1)
            slots[h] = k
        return slots

    @classmethod
    def ranks(cls, path: str) -> Vocabulary:
        """From lines of base64 bytes and rank; two tokens merge if their bytes together are one."""
        with open(path, "rb") as lines:
            ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        pairs = {(ids[t[:k]], ids[t[k:]]): (r, r) for t, r in ids.items() for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids}
        return cls({i: b for b, i in ids.items()}, pairs, whole=True)

    @classmethod
    def merges(cls, path: str) -> Vocabulary:
        """From a file of vocabulary and merges, whose strings write bytes as printable characters."""
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ids = model["vocab"]
        pairs = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        return cls(token_bytes(ids), pairs, whole=False)

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair among the keys, or -1."""
        wanted = left << 20 | right
        at = self._hash(wanted)
        found = self.slots[at].astype(np.int64)
        out = np.where((found >= 0) & (self.keys[found] == wanted), found, -1)
        todo = np.flatnonzero((found >= 0) & (out < 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.SLOT_BITS) - 1)
            found = self.slots[at[todo]].astype(np.int64)
            hit = (found >= 0) & (self.keys[found] == wanted[todo])
            out[todo[hit]] = found[hit]
            todo = todo[(found >= 0) & ~hit]
        return out

    def _merge_rows(self, rows: list[bytes]) -> Iterator[bytes]:
        """Ids of short pieces of one length, every row merging its lowest pair in each round."""
        width, never = len(rows[0]), np.int64(1) << 40
        ids = self.byte_ids[np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), width)]
        owner, out = np.arange(len(rows)), [b""] * len(rows)
        place = self._find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        while True:
            rank = np.where(place >= 0, self.ranks[place], never)
            column = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(ids), np.int64)
            done = np.take_along_axis(rank, column[:, None], 1)[:, 0] == never if rank.shape[1] else np.ones(len(ids), bool)
            if done.any():
                data, step = ids[done].astype("<u4").tobytes(), 4 * ids.shape[1]
                for k, i in enumerate(owner[done].tolist()):
                    out[i] = data[k * step : (k + 1) * step]
                if done.all():
                    return iter(out)
                ids, place, owner, column = ids[~done], place[~done], owner[~done], column[~done]
            # each row loses one token: what stands right of the merged pair moves one place to the left
            every = np.arange(len(ids))
            token = self.merged[place[every, column]]
            keep = np.arange(ids.shape[1])[None, :] != (column + 1)[:, None]
            ids = ids[keep].reshape(len(ids), -1)
            ids[every, column] = token
            keep = np.arange(place.shape[1])[None, :] != column[:, None]
            place = place[keep].reshape(len(ids), -1)
            left, right = np.flatnonzero(column > 0), np.flatnonzero(column < ids.shape[1] - 1)
            place[left, column[left] - 1] = self._find(ids[left, column[left] - 1], token[left])
            place[right, column[right]] = self._find(token[right], ids[right, column[right] + 1])

    def _merge_long(self, piece: bytes) -> bytes:
        """Ids of one long piece: a heap of pairs over a linked list, leftmost first among equals."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n, pairs = len(ids), self.pairs
        before, behind = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(pairs[p][0], k, *p) for k, p in enumerate(zip(ids, ids[1:])) if p in pairs]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            r = behind[k]
            if ids[k] != a or r >= n or ids[r] != b:
                continue
            ids[k], ids[r] = pairs[a, b][1], -1
            behind[k] = behind[r]
            if behind[k] < n:
                before[behind[k]] = k
            for x, y in ((before[k], k), (k, behind[k])):
                if x >= 0 and y < n and (pair := (ids[x], ids[y])) in pairs:
                    heapq.heappush(heap, (pairs[pair][0], x, *pair))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def learn(self, missed: Iterable[str]) -> None:
        """Put pieces into the cache."""
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for piece in missed:
            data = piece.encode("utf-8", "replace")
            known = self.ids.get(data) if self.whole or len(data) == 1 else None
            if known is not None:
                self.cache[piece] = struct.pack("<I", known)
            elif len(data) > LONG_PIECE:
                self.cache[piece] = self._merge_long(data)
            else:
                by_length.setdefault(len(data), []).append((piece, data))
        for group in by_length.values():
            for k in range(0, len(group), 20_000):
                part = group[k : k + 20_000]
                self.cache.update(zip((p for p, _ in part), self._merge_rows([d for _, d in part])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        joined, starts, first = boundaries(texts)
        own = list(map(joined.__getitem__, map(slice, starts, starts[1:])))
        missed = set(own).difference(self.cache)
        if len(self.cache) + len(missed) > CACHE_PIECES:
            self.cache.clear()
            missed = set(own)
        self.learn(missed)
        coded = list(map(self.cache.__getitem__, own))
        return [b"".join(coded[a:b]) for a, b in zip(first, first[1:])]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes) -> np.ndarray:
        """Where each id's bytes begin in the decoded bytes, and their end."""
        return np.concatenate([[0], np.cumsum([len(self.tokens[i]) for i in np.frombuffer(ids, "<u4").tolist()], dtype=np.int64)]).astype(np.int64)


_LOADED: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(kind: str, path: str) -> Vocabulary:
    """A vocabulary, read once in each Python process. kind: ranks or merges."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = getattr(Vocabulary, kind)(path)
    return _LOADED[kind, path]


ENCODED = "doc_id long, n_tokens long, ids binary, offsets array<long>"


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", offsets: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, offsets) of every row: ids as little-endian 32-bit integers, and where each id's bytes begin in the text's UTF-8.

    A null or empty text has no ids. Rows that repeat stay. Other columns are left out.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary("ranks", path)
        for batch in batches:
            for start, texts in columns.slices(batch, "text"):
                ids = vocab.encode(texts)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(start, len(texts)),
                        "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                        "ids": pa.array(ids, pa.binary()),
                        "offsets": pa.array([vocab.offsets(x)[:-1].tolist() if offsets else None for x in ids], pa.list_(pa.int64())),
                    }
                )

    return docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"`{text}` text").mapInArrow(work, ENCODED)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long"


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As encode() and a decoding of its ids, but with digests in place of ids and bytes, so that neither leaves the executor."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary("ranks", path)
        for batch in batches:
            for start, texts in columns.slices(batch, "text"):
                ids = vocab.encode(texts)
                decoded = list(map(vocab.decode, ids))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(start, len(texts)),
                        "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                        "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                        "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in decoded],
                        "n_bytes": pa.array(list(map(len, decoded)), pa.int64()),
                    }
                )

    return docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"`{text}` text").mapInArrow(work, DIGESTS)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, data) of rows with ids; null ids give empty bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary("ranks", path)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "data": pa.array([vocab.decode(x.as_py() or b"") for x in batch.column(1)], pa.binary())})

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, data binary")
