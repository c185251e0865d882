"""What the operators of this subpackage share: scratch tables, checked broadcasts, null rules.

Scratch data goes to the folder that the session names in ``spark.checkpoint.dir``; only in a local
session where that is unset (tests, notebooks) a local folder is made and set.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Most bytes that checked_broadcast() lets a side have.
BROADCAST_LIMIT = 8 << 20


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder; nothing is created yet."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write df as Parquet to shared scratch and read it back: lineage ends, and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast only if the counted rows fit the limit; else leave the join to shuffle.

    df should be a stored table, so that the count reads only Parquet footers.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def whole_text(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def only(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Just the named inputs under the operator's own names, so that other columns can't clash."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in columns.items()])


def quoted(name: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, base: str) -> str:
    """base, or base with more underscores, whichever no column of df is called (in any case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


#: What workers keep between tasks, as functions that drop it.
KEPT: list[Callable[[], None]] = []


def release(kept: bool = True) -> None:
    """Give a worker's unused memory back to the system, and what earlier stages kept in it; workers outlive their stages."""
    if kept:
        for drop in KEPT:
            drop()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """mapInArrow for columns of any name, dots included: plain names go in and out, and columns are told by their places."""
    plain = [f"c{k}" for k in range(len(schema))]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=plain)

    out = StructType([StructField(c, f.dataType) for c, f in zip(plain, schema, strict=True)])
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]).mapInArrow(named, out).toDF(*schema.names)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, column: int | None = None, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches in parts of a few rows, so that a task holds few texts as Python objects at a time.

    With a column (of texts, bytes or lists) a part also ends before it would hold over `most` bytes or elements,
    unless it is a single row. When the task's rows end, the worker gives its unused memory back.
    """
    for batch in batches:
        at = 0
        if column is not None:
            values = batch.column(column)
            sizes = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
            ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while at < batch.num_rows:
            n = rows
            if column is not None:
                n = min(n, max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")) - at))
            yield batch.slice(at, n)
            at += n
    release(kept=False)
