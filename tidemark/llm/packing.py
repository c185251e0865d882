"""Best-fit packing of documents into sequences, under several capacities at once.

Every piece asks for a vector: tokens, one document, attention cost (its length squared). A bin
has a residual of each. Among the open bins that can take a piece under *every* capacity, the
one with the best score wins: the smallest norm of the weighted residual after placement
(``residual``), or the largest weighted dot product of demand and residual (``dot``).

Texts never move: a task encodes its documents and emits piece lengths. Pieces that fill a
sequence are bins of their own; the others are dealt evenly, by a hash of the row, into groups of about
GROUP_PIECES and each group is packed on its own, longest first, so work spreads over tasks and
the loss is at most a few part-filled bins a group.

Defined cases: null text is the empty text (a piece of the end id alone); repeated rows are
separate pieces with the same numbers; null ids are packed too; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import free_name, only, stored, whole_text
from .word_tokens import encoder

GROUP_PIECES = 12_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut each encoded document (ids, then end_id) into pieces of at most capacity ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):
                for doc_id, tokens in zip(ids[at : at + 256], encode.encode(texts[at : at + 256].to_pylist()), strict=True):
                    whole = np.append(tokens, encode.dtype.type(end_id)).astype("<u4")
                    for k, start in enumerate(range(0, len(whole), capacity)):
                        part = whole[start : start + capacity]
                        out.append((doc_id, k, start, len(part), zlib.crc32(part.tobytes())))
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        encode.rest()

    return only(docs, doc_id=F.col(id_col).cast("long"), text=whole_text(text_col)).mapInArrow(cut, PIECES)


def best_fit(lengths: np.ndarray, capacities: tuple[float, float, float], weights: tuple[float, float, float], rule: str = "residual") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length. Longest first; ties in the given order."""
    caps, w = np.array(capacities, float), np.array(weights, float)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    least = int(lengths.min()) if len(lengths) else 0
    need_least = np.array([least, 1.0, float(least) ** 2])
    room = np.empty((1024, 3))  # residuals of open bins, as shares of the capacities
    tokens_in, name = np.empty(1024, np.int64), np.empty(1024, np.int64)
    n = made = 0
    smallest = need_least / caps - 1e-12
    for k in order:
        size = float(lengths[k])
        need = np.array([size, 1.0, size * size]) / caps
        left = room[:n] - need
        fits = (left >= -1e-12).all(axis=1)
        best = -1
        if fits.any():
            score = ((left * left) @ w) if rule == "residual" else -((room[:n] * need) @ w)
            best = int(np.where(fits, score, np.inf).argmin())
        if best < 0:
            if n == len(room):
                room, tokens_in, name = (np.concatenate([a, np.empty_like(a)]) for a in (room, tokens_in, name))
            best, n = n, n + 1
            room[best], tokens_in[best], name[best] = 1.0, 0, made
            made += 1
        bins[k], offsets[k] = name[best], tokens_in[best]
        room[best] -= need
        tokens_in[best] += lengths[k]
        if (room[best] < smallest).any():  # nothing more fits: close it
            n -= 1
            room[best], tokens_in[best], name[best] = room[n], tokens_in[n], name[n]
    return bins, offsets


def pack(sized: DataFrame, capacity: int = 2048, max_documents: int | None = None, max_attention: float | None = None,
         weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "residual", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add sequence_id and offset to pieces (a stored table with doc_id, piece, length and whatever else).

    max_documents and max_attention default to values that a full sequence can always reach.
    """
    if rule not in ("residual", "dot"):
        raise ValueError("rule is 'residual' or 'dot'")
    caps = (float(capacity), float(max_documents or capacity), float(max_attention or float(capacity) ** 2))
    schema = sized.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    groups = max(1, -(-sized.count() // group_pieces))

    def fill(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets = best_fit(part["length"].to_numpy(np.int64), caps, weights, rule)
        part["sequence_id"], part["offset"] = key[0] << 32 | bins, offsets
        return part.drop(columns=name)

    # dealt by the row's number in the stored table, not by its id: null or repeated ids are no hot group
    name = free_name(sized, "group")
    group = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long")
    inside = [c if c in ("doc_id", "piece", "length") else f"other{k}" for k, c in enumerate(sized.columns)]  # names with dots can't go in
    plain = StructType([StructField(c, f.dataType) for c, f in zip([*inside, "sequence_id", "offset"], schema, strict=True)])
    return sized.toDF(*inside).withColumn(name, group).groupBy(name).applyInPandas(fill, plain).toDF(*schema.names)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(stored(pieces(docs, vocabulary, end_id, capacity, id_col, text_col), "pieces"), capacity, **options)
