"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Method. Vectors are packed into blocks; a block has, for each dimension, the list of its vectors by descending value.
A query walks all lists of a block in step, from the front where its own component is positive or zero and from the
back where it is negative, in strides that double; vectors met for the first time are scored whole. The bound is the
inner product of the query with the values at the reached places: no vector still unseen can score more. The walk
stops when the bound is below the kth score found so far, in this block or an earlier one (equal scores go on, since
an unseen vector of that score may have the smaller id), or when the whole block has been seen.

Plan. Blocks with their lists are written once to shared scratch, as are the queries, which know the place of their own
row. Queries in groups of QUERIES meet blocks in groups of about BLOCKS in one task each, a stated query set against all
rows in blocks; the kth score goes along from block to block of a group. Each such task gives at most k rows a query,
of which the best k are taken. Nothing is broadcast and a task holds BLOCKS blocks and QUERIES queries on average.

Defined cases: null vectors and those that hold a null, NaN or infinite component take no part, nor do those whose
scaled integers pass +-2^27, as their scores may not fit a long. Vectors of other lengths count as filled up with zeros.
Only a query's own row is left out: other rows of the same id, and equal vectors, are candidates. Rows without id are
no queries; as candidates they come last among equals. Queries without candidates, and empty tables, give no rows.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import map_rows, only, release, stored
from .sharded_lloyd import packed, scaled

#: Vectors of a block and its bytes at most; blocks and queries that meet in a task, on average.
BLOCK, BLOCK_BYTES, BLOCKS, QUERIES = 8192, 4 << 20, 2, 1024
#: Places of a list that a walk takes first.
STRIDE = 32


def vectors_of(table: DataFrame, is_query: Column, scale: int, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(v, id, asked of the vectors that take part, all of one length; that length)."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asked"), scaled(F.col(vector_col), scale).alias("v")).filter("v IS NOT NULL")
    dims = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 0)
    return rows.select(F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("v"))).alias("v"), "id", "asked"), dims


def sorted_blocks(rows: DataFrame, dims: int) -> DataFrame:
    """block, n, ids, asked, data (int32, a row a vector), lists (int32, a row a dimension: its vectors' places by descending value)."""

    def make(number: int, values: np.ndarray, rest: list[pa.Array]) -> pa.RecordBatch:
        lists = np.argsort(-values, axis=0, kind="stable").T
        row = [[number], [len(values)], [rest[0].to_pylist()], [rest[1].to_pylist()], [values.astype("<i4").tobytes()], [np.ascontiguousarray(lists, "<i4").tobytes()]]
        types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types, strict=True)], names=["block", "n", "ids", "asked", "data", "lists"])

    size = max(1, min(BLOCK, BLOCK_BYTES // (4 * dims)))
    return packed(rows, dims, size, "block long, n int, ids array<bigint>, asked array<boolean>, data binary, lists binary", make)


def queries_of(blocks: DataFrame, dims: int) -> DataFrame:
    """query_id, block, at (place of the query's own row), q (int32) of every row that asks."""
    schema = StructType.fromDDL("query_id long, block long, at int, q binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block, ids, asked, data = row.values()
                at = [k for k, a in enumerate(asked) if a]
                values = np.frombuffer(data, "<i4").reshape(-1, dims)
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in at], pa.int64()), pa.array([block] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array([values[k].tobytes() for k in at], pa.binary())], names=schema.names)
        release(kept=False)

    return map_rows(blocks.select("block", "ids", "asked", "data"), run, schema)


class Block:
    """A block's vectors and sorted lists; integers are held as doubles where no score can pass 2^53."""

    def __init__(self, number: int, ids: list[int | None], data: bytes, lists: bytes, dims: int, largest: int):
        self.number, n = number, len(ids)
        x = np.frombuffer(data, "<i4").reshape(n, dims)
        exact = float(max(1, abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) * largest * dims < 2.0**53
        self.x = x.astype(np.float64 if exact else np.int64)
        self.lists = np.frombuffer(lists, "<i4").reshape(dims, n)
        known = [i for i in ids if i is not None]
        self.ids = np.array([max(known, default=0) if i is None else i for i in ids], np.int64)
        self.none = np.array([i is None for i in ids])

    def walk(self, q: np.ndarray, own: int | None, k: int, least: int | None) -> list[tuple[int, bool, int]]:
        """(score, whether without id, id) of the vectors that may be among the best k; least: a score that k others reach."""
        n = len(self.ids)
        q = q.astype(self.x.dtype)
        ahead, back = np.flatnonzero(q >= 0), np.flatnonzero(q < 0)
        seen = np.zeros(n, bool)
        if own is not None:
            seen[own] = True
        left, depth, stride = n - int(seen.sum()), 0, STRIDE
        places: list[np.ndarray] = []
        scores: list[np.ndarray] = []
        best = np.zeros(0, self.x.dtype)
        dims = np.arange(len(q))
        at = np.empty(len(q), np.int64)
        while left:
            at[ahead], at[back] = depth, n - 1 - depth
            bound = (self.x[self.lists[dims, at], dims] * q).sum()
            if least is not None and bound < least:
                break
            reach = min(n, depth + stride)
            met = np.zeros(n, bool)
            met[self.lists[ahead, depth:reach].ravel()] = True
            met[self.lists[back, n - reach : n - depth].ravel()] = True
            met &= ~seen
            new = np.flatnonzero(met)
            if len(new):
                seen |= met
                left -= len(new)
                scores.append(self.x[new] @ q)
                places.append(new)
                best = np.concatenate([best, scores[-1]])
                if len(best) >= k:
                    best = np.partition(best, len(best) - k)[-k:]
                    least = max(int(best[0]), least) if least is not None else int(best[0])
            depth, stride = reach, stride * 2
        if not scores:
            return []
        found, place = np.concatenate(scores), np.concatenate(places)
        may = np.flatnonzero(found >= least) if least is not None else np.arange(len(found))
        order = np.lexsort((self.ids[place[may]], self.none[place[may]], -found[may]))[:k]
        return [(int(found[m]), bool(self.none[place[m]]), int(self.ids[place[m]])) for m in may[order]]


def best_of_blocks(blocks: DataFrame, queries: DataFrame, dims: int, k: int) -> DataFrame:
    """query_id, block, at, vec_id, score: at most k rows a query from each group of blocks, the best k of all blocks among them."""
    groups, sets = max(1, -(-blocks.count() // BLOCKS)), max(1, -(-queries.count() // QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = queries.withColumns({"set": F.pmod(F.xxhash64("block", "at"), F.lit(sets)), "group": every(groups)})
    right = blocks.select("block", "ids", "data", "lists", F.pmod(F.xxhash64("block"), F.lit(groups)).alias("group"), every(sets).alias("set"))

    def meet(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "block": [], "at": [], "vec_id": [], "score": []}
        vectors = [np.frombuffer(q, "<i4") for q in asked.column("q").to_pylist()]
        largest = max((max(abs(int(q.max())), abs(int(q.min()))) for q in vectors), default=1)
        tops: list[list[tuple[int, bool, int]]] = [[] for _ in vectors]
        own = list(zip(asked.column("block").to_pylist(), asked.column("at").to_pylist(), strict=True))
        for number in range(rows.num_rows if vectors else 0):
            row = {c: rows.column(c)[number].as_py() for c in ("block", "ids", "data", "lists")}
            block = Block(row["block"], row["ids"], row["data"], row["lists"], dims, largest)
            for m, q in enumerate(vectors):
                top = tops[m]
                found = block.walk(q, own[m][1] if own[m][0] == block.number else None, k, top[-1][0] if len(top) == k else None)
                if found:
                    tops[m] = sorted(top + found, key=lambda t: (-t[0], t[1], t[2]))[:k]
        for (block, at), query, top in zip(own, asked.column("query_id").to_pylist(), tops, strict=True):
            for score, none, name in top:
                for column, value in zip(out.values(), (query, block, at, None if none else name, score), strict=True):
                    column.append(value)
        types = {"query_id": pa.int64(), "block": pa.int64(), "at": pa.int32(), "vec_id": pa.int64(), "score": pa.int64()}
        return pa.table({c: pa.array(v, types[c]) for c, v in out.items()})

    return left.groupBy("set", "group").cogroup(right.groupBy("set", "group")).applyInArrow(meet, "query_id long, block long, at int, vec_id long, score long")


def top_k(table: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of the largest integer inner product with each query, ties to the smaller id."""
    rows, dims = vectors_of(table, is_query & F.col(id_col).isNotNull(), scale, id_col, vector_col)
    blocks = stored(sorted_blocks(rows, dims), "sorted-blocks")
    queries = stored(queries_of(blocks, dims), "queries")
    found = best_of_blocks(blocks, queries, dims, k)
    order = Window.partitionBy("block", "at").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())  # k rows a group of blocks
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
