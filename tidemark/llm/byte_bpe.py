"""Byte-level BPE with a segment tree over byte positions, and decoding.

A piece of n bytes gets a tree whose leaf p holds (rank of the pair that starts at p, p), or
infinity; the root is the leftmost minimum. A merge rewrites three leaves — the merged pair's, its
left neighbour's and the swallowed one's — and climbs from each, so it costs O(log n). Short
pieces run many at a time as rows of numpy trees of one size; long ones run alone on lists.

Texts are cut by the tokenizer's pattern, each distinct piece is encoded once and a bounded memo
serves the rest of the worker's texts.

Defined cases: null text is the empty text (no ids); empty tables give no rows; repeated rows and
null ids stay; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, whole_text

MEMO_LIMIT = 300_000
#: Pieces of at most so many bytes run in numpy batches.
BATCHED_BYTES = 128
NONE = np.iinfo(np.int64).max

_coders: dict[tuple[str, str], "ByteBpe"] = {}


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.find = regex.compile(pattern).findall
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.memo: dict[str, tuple[int, ...]] = {}

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 where a pair is none."""
        keys = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def merge_batch(self, pieces: list[bytes], leaves: int) -> list[tuple[int, ...]]:
        """Encode pieces of at most `leaves` bytes, a power of two, all at once."""
        n = len(pieces)
        size = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), np.uint8).reshape(n, leaves)
        at = np.arange(leaves)
        token = np.where(at < size[:, None], self.byte_ids[raw], -1)
        token = np.concatenate([token, np.full((n, 1), -1)], axis=1)  # position `leaves` is past the end
        after = np.minimum(np.tile(at + 1, (n, 1)), size[:, None])
        after = np.where(after >= size[:, None], leaves, after)
        before = np.tile(at - 1, (n, 1))
        tree = np.full((n, 2 * leaves), NONE)

        def leaf(rows: np.ndarray, p: np.ndarray) -> np.ndarray:
            a, b = token[rows, p], token[rows, after[rows, p]]
            ranks = np.full(len(rows), -1)
            live = (a >= 0) & (b >= 0)
            ranks[live] = self.rank_of(a[live], b[live])
            return np.where(ranks >= 0, ranks * leaves + p, NONE)

        rows, cols = np.nonzero(at < size[:, None] - 1)
        tree[rows, leaves + cols] = leaf(rows, cols)
        half = leaves
        while half > 1:
            half //= 2
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
        live = np.flatnonzero(tree[:, 1] != NONE)
        while len(live):
            best = tree[live, 1]
            p = best % leaves
            q = after[live, p]
            token[live, p] = best // leaves
            token[live, q] = -1
            follow = after[live, q]
            after[live, p] = follow
            inner = follow < leaves
            before[live[inner], follow[inner]] = p[inner]
            tree[live, leaves + q] = NONE
            tree[live, leaves + p] = leaf(live, p)
            left = before[live, p]
            has = left >= 0
            tree[live[has], leaves + left[has]] = leaf(live[has], left[has])
            for rows, leafs in ((live, q), (live, p), (live[has], left[has])):
                node = (leaves + leafs) // 2
                while len(rows) and node[0] >= 1:
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node = node // 2
            live = live[tree[live, 1] != NONE]
        return [tuple(t[t >= 0].tolist()) for t in token]

    def merge_one(self, piece: bytes) -> tuple[int, ...]:
        """Encode one piece of any length."""
        n = len(piece)
        leaves = 1 << max(1, (n - 1).bit_length())
        token = [int(self.byte_ids[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none = 1 << 62
        tree = [none] * (2 * leaves)
        get = self.pairs.get

        def leaf(p: int) -> int:
            q = after[p]
            rank = get(token[p] << 32 | token[q]) if q < n else None
            return none if rank is None else rank * leaves + p

        for p in range(n - 1):
            tree[leaves + p] = leaf(p)
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(p: int, value: int) -> None:
            node = leaves + p
            tree[node] = value
            while node > 1:
                node //= 2
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    break
                tree[node] = least

        while tree[1] != none:
            rank, p = divmod(tree[1], leaves)
            q = after[p]
            token[p], token[q] = rank, -1
            after[p] = after[q]
            if after[p] < n:
                before[after[p]] = p
            put(q, none)
            put(p, leaf(p))
            if before[p] >= 0:
                put(before[p], leaf(before[p]))
        return tuple(t for t in token if t >= 0)

    def learn(self, pieces: list[str]) -> None:
        """Put the ids of pieces into the memo."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            data = piece.encode()
            rank = self.ranks.get(data)
            if rank is not None:
                self.memo[piece] = (rank,)
            elif len(data) > BATCHED_BYTES:
                self.memo[piece] = self.merge_one(data)
            else:
                by_size.setdefault(max(4, 1 << (len(data) - 1).bit_length()), []).append((piece, data))
        for leaves, found in by_size.items():
            step = max(256, (1 << 19) // leaves)
            for at in range(0, len(found), step):
                part = found[at : at + step]
                self.memo.update(zip((p for p, _ in part), self.merge_batch([d for _, d in part], leaves), strict=True))

    def encode(self, texts: list[str]) -> list[list[int]]:
        cut = [self.find(t) for t in texts]
        wanted = set().union(*cut) if cut else set()
        new = list(wanted.difference(self.memo))
        if len(self.memo) + len(new) > MEMO_LIMIT:
            self.memo.clear()
            new = list(wanted)
        self.learn(new)
        get = self.memo.__getitem__
        return [[i for p in pieces for i in get(p)] for pieces in cut]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def coder(path: str, pattern: str) -> ByteBpe:
    """One coder a worker, vocabulary file and pattern."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = ByteBpe(path, pattern)
    return _coders[path, pattern]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = bpe.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return only(docs, doc_id=F.col(id_col).cast("long"), text=whole_text(text_col)).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, data (the decoded bytes) of a table with doc_id and ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary, pattern)
        for batch in batches:
            data = [None if ids is None else bpe.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, then decodes the ids, a slice of texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary, pattern)
        for batch in batches:
            rows: list[tuple[int, str, str]] = []
            for at in range(0, batch.num_rows, 256):
                for ids in bpe.encode(batch.column(1)[at : at + 256].to_pylist()):
                    decimal = ",".join(map(str, ids)).encode()
                    rows.append((len(ids), hashlib.sha256(decimal).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return only(docs, doc_id=F.col(id_col).cast("long"), text=whole_text(text_col)).mapInArrow(run, schema)
