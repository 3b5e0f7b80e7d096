"""Byte-level BPE: each piece's merges are found in a segment tree over its byte positions.

A leaf holds the rank of the pair that starts at its position (infinite where there is none), with the position as
tie-break, so the root is the leftmost pair of least rank. A merge takes the right-hand token out of a linked list
of live positions and sets three leaves anew: the merged position, its left neighbour, and the position that is
gone. Each costs one walk to the root. Short pieces are merged many at a time, one tree a row of a numpy array;
long ones have a tree of their own, so a piece of n bytes takes O(n log n).

The rank file is read on the driver and broadcast: its size is fixed. Words recur, so each worker keeps the tokens
of pieces it has met, up to CACHE_PIECES.

Defined results: a null or empty text has no tokens; a piece that is itself a token is that token; repeated rows are
encoded each; a null doc_id passes through; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

NONE = np.int64(1) << 62
#: Pieces of up to this many bytes share array trees; POS_BITS of a leaf are its position.
SHARED_BYTES, POS_BITS = 64, 6
CACHE_PIECES = 500_000

_CODERS: dict[bytes, BytePairCoder] = {}


class BytePairCoder:
    """Encodes and decodes by a rank file: lines of a token in base64 and its rank, which is its id."""

    def __init__(self, ranks: bytes, pattern: str):
        pairs = (line.split() for line in ranks.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.pattern = regex.compile(pattern)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.decimals = {rank: str(rank) for rank in self.tokens}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        joined = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    joined[(left << 32) | right] = rank
        self.joined = joined
        self.pair_keys = np.array(sorted(joined), dtype=np.int64)
        self.pair_ranks = np.array([joined[k] for k in self.pair_keys.tolist()], dtype=np.int64)
        self.cache: dict[str, tuple[int, ...]] = {}

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of joining each pair of ids, NONE where they don't join or a side (-1) is missing."""
        key = (left << np.int64(32)) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], NONE)

    def merge_many(self, pieces: list[bytes], size: int) -> list[tuple[int, ...]]:
        """The tokens of pieces of 2 to `size` bytes; size is a power of two, SHARED_BYTES at most."""
        n, spot = len(pieces), np.arange(size)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
        ids = np.full((n, size + 1), -1, dtype=np.int64)
        ids[:, :size] = np.where(spot < lengths[:, None], self.single[raw], -1)
        after = np.minimum(np.tile(spot + 1, (n, 1)), lengths[:, None])
        before = np.tile(spot - 1, (n, 1))
        tree = np.full((n, 2 * size), NONE, dtype=np.int64)

        def leaf(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.where(rank == NONE, NONE, (rank << POS_BITS) | at)

        rows = np.arange(n)[:, None]
        first = self._rank_of(ids[:, :size], np.where(after < lengths[:, None], ids[rows, after], -1))
        tree[:, size:] = leaf(first, spot)
        for node in range(size - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])

        def put(row: np.ndarray, at: np.ndarray, rank: np.ndarray) -> None:
            node = at + size
            tree[row, node] = leaf(rank, at)
            while node[0] > 1:
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            best = tree[live, 1]
            at, rank = best & ((1 << POS_BITS) - 1), best >> POS_BITS
            gone = after[live, at]
            follow = after[live, gone]
            ids[live, at] = rank
            ids[live, gone] = -1
            after[live, at] = follow
            inner = follow < lengths[live]
            before[live[inner], follow[inner]] = at[inner]
            put(live, gone, np.full(len(live), NONE))
            put(live, at, self._rank_of(rank, np.where(inner, ids[live, np.minimum(follow, size)], -1)))
            prior = before[live, at]
            has = prior >= 0
            if has.any():
                put(live[has], prior[has], self._rank_of(ids[live[has], prior[has]], rank[has]))
            live = live[tree[live, 1] < NONE]
        kept = ids[:, :size] >= 0
        flat, ends = ids[:, :size][kept].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The tokens of one piece of any length."""
        n = len(piece)
        size = 1 << max(1, (n - 1).bit_length())
        none = (int(NONE), 0)
        ids = [int(self.single[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * size)

        def pair(i: int) -> tuple[int, int]:
            j = after[i]
            rank = self.joined.get((ids[i] << 32) | ids[j]) if j < n else None
            return none if rank is None else (rank, i)

        for i in range(n):
            tree[size + i] = pair(i)
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, value: tuple[int, int]) -> None:
            node = size + i
            tree[node] = value
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        while tree[1] < none:
            rank, at = tree[1]
            gone = after[at]
            after[at], ids[at] = after[gone], rank
            if after[at] < n:
                before[after[at]] = at
            put(gone, none)
            put(at, pair(at))
            if before[at] >= 0:
                put(before[at], pair(before[at]))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return tuple(out)

    def learn(self, pieces: set[str]) -> None:
        """Puts the tokens of these pieces into the cache."""
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.cache[piece] = (whole,)
            elif len(raw) > SHARED_BYTES:
                self.cache[piece] = self.merge_long(raw)
            else:
                groups.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((piece, raw))
        for size, found in groups.items():
            for k in range(0, len(found), 20_000):
                part = found[k : k + 20_000]
                self.cache.update(zip([p for p, _ in part], self.merge_many([r for _, r in part], size), strict=True))

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text, its pieces encoded separately."""
        split = [self.pattern.findall(t) if t else [] for t in texts]
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        known = self.cache
        new = {p for pieces in split for p in pieces if p not in known}
        if new:
            self.learn(new)
        return [list(chain.from_iterable(map(known.__getitem__, pieces))) for pieces in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def coder(ranks: bytes, pattern: str) -> BytePairCoder:
    """The coder of a rank file, built once a process."""
    key = hashlib.sha256(ranks + pattern.encode()).digest()
    if key not in _CODERS:
        _CODERS[key] = BytePairCoder(ranks, pattern)
    return _CODERS[key]


def _parts(texts: list[str | None], limit: int = 2_000_000):
    """Ranges of texts of about `limit` characters together."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _ranks_of(docs: DataFrame, path: str):
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row."""
    ranks = _ranks_of(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks.value, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _parts(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(bpe.encode_batch(texts[a:b]), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the decimal ids joined by commas and of the bytes that they decode to."""
    ranks = _ranks_of(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks.value, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _parts(texts):
                coded = bpe.encode_batch(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(map(len, coded), pa.int64()),
                        pa.array([hashlib.sha256(",".join(map(bpe.decimals.__getitem__, ids)).encode()).hexdigest() for ids in coded]),
                        pa.array([hashlib.sha256(bpe.decode(ids)).hexdigest() for ids in coded]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
