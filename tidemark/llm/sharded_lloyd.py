"""Centroid clustering by Lloyd's rounds over column blocks (dimension shards), exact in integers.

Method. Vectors are packed into chunks of CHUNK and each chunk is cut into SHARDS column blocks, rows of their own. In a
round, column-block tasks compute exact partial squared distances of a chunk's vectors to the centroids' slices of
that block; the blocks of a chunk are brought together by key, the partial distances added, and the nearest centroid
taken (smallest number on ties). The sums of each shard's columns by cluster are then added up by (shard, cluster,
column), and each shard makes its own slice of the next centroids: floor(sum / count), empty clusters keep theirs.

Plan. Column blocks are written once to shared scratch. A round is one job of two shuffles: partial distances with their
blocks by chunk, and sums by (shard, cluster, column), combined in every task before they move. Centroid slices
(clusters x columns integers, however many vectors there are) are broadcast and written each round, so a lost executor
costs its tasks and never a round. No task holds more than a chunk of vectors.

Defined cases: only vectors of exactly `dims` components that are neither null nor NaN nor infinite take part, and of
those only the ones whose scaled integers lie within +-2^27, as squared distances of others may not fit a long. Null
ids are kept and hashed last as initial centroids; vectors of one id are rows of their own, tied ones ordered by their
components. With fewer vectors than clusters, each is a centroid. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import map_rows, only, release, stored

CHUNK, SHARDS = 2048, 4
#: Larger integers take no part: 64 squared differences of them may pass 2^63.
LARGEST = 1 << 27


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component x as a double, as longs; null unless all are finite and within LARGEST."""
    # within 2^62 the conversion is exact, so that LARGEST is asked of the true integer
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale <= float(LARGEST)))
    return F.when(F.coalesce(whole, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def kept_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, v (array of longs) of the vectors that take part."""
    rows = only(vectors, id=id_col, raw=vector_col).filter(F.size("raw") == dims)
    return rows.select("id", scaled(F.col("raw"), scale).alias("v")).filter("v IS NOT NULL")


def packed(rows: DataFrame, dims: int, chunk: int, schema: str, make: Callable[[int, np.ndarray, list[pa.Array]], pa.RecordBatch]) -> DataFrame:
    """make(number, values, other columns) for every `chunk` vectors of a task and for its last ones; numbers are unique.

    rows: v (arrays of `dims` longs), then other columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, values, rest = TaskContext.get().partitionId() << 32, np.zeros((0, dims), np.int64), None
        for batch in batches:
            values = np.concatenate([values, batch.column(0).flatten().to_numpy().reshape(batch.num_rows, dims)])
            rest = batch.columns[1:] if rest is None else [pa.concat_arrays(pair) for pair in zip(rest, batch.columns[1:], strict=True)]
            while len(values) >= chunk:
                yield make(number, values[:chunk], [c.slice(0, chunk) for c in rest])
                number, values, rest = number + 1, values[chunk:], [c.slice(chunk) for c in rest]
        if len(values):
            yield make(number, values, rest)
        release(kept=False)

    return map_rows(rows, run, StructType.fromDDL(schema))


def _edges(dims: int, shards: int) -> list[tuple[int, int]]:
    ends = np.linspace(0, dims, shards + 1).astype(int).tolist()
    return list(zip(ends[:-1], ends[1:], strict=True))


BLOCKS = "chunk long, shard int, ids array<bigint>, n int, data binary"


def column_blocks(kept: DataFrame, dims: int, shards: int = SHARDS, chunk: int = CHUNK) -> DataFrame:
    """chunk, shard, ids (with shard 0 only), n, data (int32, row-major): up to `chunk` vectors of a task, cut into column blocks."""

    def make(number: int, values: np.ndarray, rest: list[pa.Array]) -> pa.RecordBatch:
        ids = rest[0]
        data = [np.ascontiguousarray(values[:, a:b], "<i4").tobytes() for a, b in _edges(dims, shards)]
        names = pa.array([ids.to_pylist()] + [None] * (shards - 1), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([number] * shards, pa.int64()), pa.array(range(shards), pa.int32()), names, pa.array([len(ids)] * shards, pa.int32()), pa.array(data, pa.binary())], names=["chunk", "shard", "ids", "n", "data"])

    return packed(kept.select("v", F.col("id").cast("long")), dims, chunk, BLOCKS, make)


def initial_slices(kept: DataFrame, clusters: int, dims: int, seed: str, shards: int = SHARDS) -> DataFrame:
    """shard, k, slices (k centroids x columns, row-major): the vectors whose sha256 of seed and id is smallest, in that order."""
    hashed = kept.select(F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256).alias("hash"), "v")
    first = hashed.orderBy(F.col("hash").asc_nulls_last(), "v").limit(clusters)  # as many rows as clusters from here on
    whole = first.agg(F.array_sort(F.collect_list(F.struct(F.col("hash").isNull().alias("none"), "hash", "v"))).alias("rows"))
    columns = lambda a, b: F.flatten(F.transform("rows", lambda r: F.slice(r["v"], a + 1, b - a)))
    parts = [F.struct(F.lit(s).alias("shard"), F.size("rows").alias("k"), columns(a, b).alias("slices")) for s, (a, b) in enumerate(_edges(dims, shards))]
    return whole.select(F.inline(F.array(*parts)))


def added_distances(blocks: DataFrame, slices: DataFrame, out: str, make: Callable[[pa.Table, np.ndarray], pa.Table]) -> DataFrame:
    """make(a chunk's column blocks in order of shard, its vectors' squared distances to all centroids) for every chunk."""
    schema = StructType.fromDDL(BLOCKS + ", k int, part binary")

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                n, k = row.column(3)[0].as_py(), row.column(5)[0].as_py()
                x = np.frombuffer(row.column(4)[0].as_py(), "<i4").astype(np.int64).reshape(n, -1)
                centroids = row.column(6).flatten().to_numpy().reshape(k, -1)
                found = np.empty((n, k), np.int64)
                for j, one in enumerate(centroids):
                    d = x - one
                    found[:, j] = np.einsum("ij,ij->i", d, d)
                part = found.astype("<i4") if found.max() < 1 << 31 else found  # the width is told by the length
                yield pa.RecordBatch.from_arrays([*row.columns[:6], pa.array([part.tobytes()], pa.binary())], names=schema.names)
        release(kept=False)

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("shard").combine_chunks()
        shape = rows.column("n")[0].as_py(), rows.column("k")[0].as_py()
        total = np.zeros(shape, np.int64)
        for part in rows.column("part").to_pylist():
            total += np.frombuffer(part, "<i4" if len(part) == 4 * total.size else "<i8").reshape(shape)
        return make(rows, total)

    joined = blocks.join(F.broadcast(slices), "shard").select("chunk", "shard", "ids", "n", "data", "k", "slices")
    return map_rows(joined, distances, schema).groupBy("chunk").applyInArrow(add, out)


def next_slices(blocks: DataFrame, slices: DataFrame) -> DataFrame:
    """The centroids' slices after a round; each shard makes its own."""

    def sums(rows: pa.Table, distances: np.ndarray) -> pa.Table:
        cluster, k = distances.argmin(axis=1), distances.shape[1]
        count, order = np.bincount(cluster, minlength=k), np.argsort(cluster, kind="stable")
        some = np.flatnonzero(count)
        starts = np.searchsorted(cluster[order], some)
        made: dict[str, list[pa.Array]] = {"shard": [], "cluster": [], "n": [], "s": []}
        for shard, data in zip(rows.column("shard").to_pylist(), rows.column("data").to_pylist(), strict=True):
            x = np.frombuffer(data, "<i4").astype(np.int64).reshape(len(cluster), -1)[order]
            own = [np.full(len(some), shard, np.int32), some, count[some], list(np.add.reduceat(x, starts))]
            for name, values in zip(made, own, strict=True):
                made[name].append(pa.array(values))
        return pa.table({name: pa.concat_arrays(parts) for name, parts in made.items()})

    found = added_distances(blocks, slices, "shard int, cluster long, n long, s array<bigint>", sums)
    summed = found.select("shard", "cluster", "n", F.posexplode("s").alias("at", "x")).groupBy("shard", "cluster", "at").agg(F.sum("x").alias("s"), F.sum("n").alias("n"))
    floor = F.expr("(s - pmod(s, n)) div n")
    moved = summed.select("shard", "cluster", "at", floor.alias("x")).groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("cluster", "at").alias("key"), "x"))).alias("moved"))  # clusters x columns of a shard at most
    width = (F.size("slices") / F.col("k")).cast("int")
    place = lambda i: F.struct(F.floor(i / width).cast("long").alias("cluster"), (i % width).cast("int").alias("at"))
    new = F.transform("slices", lambda x, i: F.coalesce(F.try_element_at("moved", place(i)), x))
    return slices.join(F.broadcast(moved), "shard", "left").select("shard", "k", F.when(F.col("moved").isNotNull(), new).otherwise(F.col("slices")).alias("slices"))


def lloyd(vectors: DataFrame, dims: int = 64, clusters: int = 40, rounds: int = 5, scale: int = 256, seed: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(id, cluster, distance of every vector that takes part; shard, k, slices of the final centroids)."""
    kept = kept_vectors(vectors, dims, scale, id_col, vector_col)
    slices = stored(initial_slices(kept, clusters, dims, seed), "centroids")
    blocks = stored(column_blocks(kept, dims), "column-blocks")
    for _ in range(rounds):
        slices = stored(next_slices(blocks, slices), "centroids")

    def nearest(rows: pa.Table, distances: np.ndarray) -> pa.Table:
        cluster = distances.argmin(axis=1)
        return pa.table({"id": rows.column("ids").combine_chunks().slice(0, 1).flatten(), "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(distances[np.arange(len(cluster)), cluster])})

    return stored(added_distances(blocks, slices, "id long, cluster int, distance long", nearest), "clusters"), slices


def clustered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    rows, slices = lloyd(vectors, id_col=id_col, vector_col=vector_col, **options)
    per = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    per = per.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))  # at most as many rows as clusters
    # shards in order, each cut into the centroids' parts; as many rows as clusters
    width = F.expr("size(slices) div k")
    cut = slices.filter("k > 0").select("shard", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda c: F.slice("slices", c * width + 1, width))).alias("cluster", "part"))
    whole = cut.groupBy("cluster").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("shard", "part"))), lambda p: p["part"])).alias("c"))
    named = whole.select("cluster", F.sha2(F.array_join(F.transform("c", lambda x: x.cast("string")), ","), 256).alias("centroid_sha256"))
    about = per.join(named, "cluster")
    return rows.join(F.broadcast(about), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
