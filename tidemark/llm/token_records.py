"""Token ids as length-delimited binary records with masked checksums, and their offset index.

A file is a run of records and one closing line feed. A record is

    length      uint64, bytes of the payload
    check       uint32, masked CRC-32 of the eight length bytes
    payload     int64 document id, uint8 1 if the id is known, uint8 bytes an id (2 or 4), the ids
    check       uint32, masked CRC-32 of the payload

all little-endian; the mask is the CRC rotated right by 15 bits plus 0xA282EAD8. Files hold one
block each, of at most BLOCK_BYTES or one longer record, and their names sort by task and block,
which is ascending document order. The index is a Parquet table beside them with a row a record:
file, offset, length, tokens, checksum of the ids, for shuffled reads.

Blocks leave Spark through its text sink as raw bytes, so any file system that Spark writes to
will do. Texts cross one range shuffle; ids are made after it and only written.

Defined cases: null text is the empty text (end id only); null ids sort first; rows that repeat
stay, one record each; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, whole_text
from .word_tokens import encoder

BLOCK_BYTES = 8 << 20
MASK_DELTA = 0xA282EAD8


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    payload = struct.pack("<qBB", doc_id or 0, doc_id is not None, ids.dtype.itemsize) + ids.tobytes()
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def record_at(data: bytes | memoryview, at: int) -> tuple[int, int | None, np.ndarray]:
    """Length of the whole record that begins at a byte, document id, ids; ValueError if a check fails."""
    (size,) = struct.unpack_from("<Q", data, at)
    (check,) = struct.unpack_from("<I", data, at + 8)
    if masked_crc(data[at : at + 8]) != check:
        raise ValueError(f"damaged length at byte {at}")
    payload = data[at + 12 : at + 12 + size]
    if len(payload) != size or masked_crc(payload) != struct.unpack_from("<I", data, at + 12 + size)[0]:
        raise ValueError(f"damaged record at byte {at}")
    doc_id, known, width = struct.unpack_from("<qBB", payload)
    return size + 16, doc_id if known else None, np.frombuffer(payload, f"<u{width}", offset=10)


def frames(data: bytes) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, length of the whole record, document id, ids) of each record; ValueError if a check fails."""
    at, end = 0, len(data) - 1  # the last byte is the line feed
    while at < end:
        size, doc_id, ids = record_at(data, at)
        yield at, size, doc_id, ids
        at += size


def write_token_records(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append end_id, write the records in ascending document order."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        end = np.array([end_id], encode.dtype)
        held: list[bytes] = []
        size = 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["block"])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):
                part = encode.encode(texts[at : at + 256].to_pylist())
                for doc_id, tokens in zip(ids[at : at + 256], part, strict=True):
                    record = frame(doc_id, np.concatenate([tokens, end]))
                    if held and size + len(record) > BLOCK_BYTES:
                        yield block()
                        held.clear()
                        size = 0
                    held.append(record)
                    size += len(record)
        if held:
            yield block()
        encode.rest()

    rows = only(docs, doc_id=F.col(id_col).cast("long"), text=whole_text(text_col))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    made = ordered.mapInArrow(blocks, "block binary").select(F.col("block").cast("string").alias("value"))
    made.write.option("maxRecordsPerFile", 1).option("compression", "none").text(f"{path}/records")


def index_token_records(spark: SparkSession, path: str) -> DataFrame:
    """Read the record files back, check every sum, write and return the offset index."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                file = name.rsplit("/", 1)[1]
                task, block = int(file.split("-")[1]), int(file.rsplit("-c", 1)[1].split(".")[0])
                found = [(file, task, block, n, at, size, doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for n, (at, size, doc_id, ids) in enumerate(frames(content))]
                out = pd.DataFrame(found, columns=["file", "task", "block", "record", "offset", "length", "doc_id", "n_tokens", "ids_crc32"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records").select("path", "content")
    schema = "file string, task int, block int, record int, offset long, length long, doc_id long, n_tokens long, ids_crc32 long"
    files.mapInPandas(parse, schema).write.mode("overwrite").parquet(f"{path}/index")
    return spark.read.schema(schema).parquet(f"{path}/index")


def with_starts(index: DataFrame) -> DataFrame:
    """Add `start`, the ids of all records before: sums of tasks first (a row a write task), then inside each task."""
    sums = index.groupBy("task").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("task").orderBy("block", "record").rowsBetween(Window.unboundedPreceding, -1)
    return index.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(bases, "task").withColumn("start", F.col("base") + F.col("inner")).drop("base", "inner")


def read_records(spark: SparkSession, path: str, picked: DataFrame) -> DataFrame:
    """Ids of picked index rows (columns file, offset; any order), by file: doc_id, ids."""

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [record_at(memoryview(bytes(content)), int(offset)) for content in right["content"] for offset in left["offset"]]
        return pd.DataFrame([(doc_id, ids.astype("int32").tolist()) for _, doc_id, ids in found], columns=["doc_id", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return picked.select("file", "offset").groupBy("file").cogroup(files.groupBy("file")).applyInPandas(both, "doc_id long, ids array<int>")
