"""Language identification by string kernels.

The kernel is the blended spectrum on presence: two texts share a byte n-gram (1 to 3 bytes,
lower-cased text) or not, n-grams hashed to FEATURES slots, and the number of shared slots is
divided by the geometric mean of the two counts. Landmarks give a Nyström map of the kernel, and
one-versus-rest kernel ridge regression learns a score for each language on it.

Training uses a bounded sample of labelled rows, SAMPLE_PER_LANGUAGE for each language, those with
the smallest hash of their id and text; the bound is a parameter, and rows that repeat an id and text
count once, however many they are, in the sample and in the sizes of languages. Scoring is a matrix product for each batch
of texts: presence rows times (landmark rows times Nyström map times weights).

Defined cases: null text, or text without a letter, is ``und`` with score 0; nothing learned:
every row is ``und``; repeated rows get equal answers; empty tables give no rows; ids may be null
(not learned from); more than MOST_LANGUAGES labels are refused; other columns never reach a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, map_rows, only, quoted, release, slices

FEATURES = 1 << 14
SAMPLE_PER_LANGUAGE = 400
LANDMARKS = 256
UNKNOWN = "und"
#: Learning from more labels than this is refused: the sample is gathered in one place.
MOST_LANGUAGES = 1000


#: Bytes looked at together; a longer text is looked at in parts that overlap.
PART = 1 << 18


def presence(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES zeros and ones for each text."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= PART:
            size += len(texts[end])
            end += 1
        if size <= PART:
            _mark(out[at:end], texts[at:end])
        else:
            for k in range(0, size, PART):
                _mark(out[at:end], [texts[at][k : k + PART + 2]])
        at = end
    return out


def _mark(out: np.ndarray, texts: list[bytes]) -> None:
    flat = out.reshape(-1)
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int64) * FEATURES, [len(t) for t in texts])
    gram = data
    flat[row + (gram * np.uint32(2654435761) >> np.uint32(18)).astype(np.int64)] = 1
    for n in (2, 3):
        if len(data) < n:
            break
        gram = gram[:-1] * np.uint32(257) + data[n - 1 :] + np.uint32(n)
        inside = row[: len(gram)] == row[n - 1 :]
        slot = (gram * np.uint32(2654435761) >> np.uint32(18)).astype(np.int64)
        flat[(row[: len(gram)] + slot)[inside]] = 1


def normalised(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # FEATURES x languages
    bias: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return normalised(presence(texts)) @ self.weights + self.bias


#: Presence rows that fit() holds as floats at a time, beside the landmarks.
BLOCK = 64


def _floats(present: np.ndarray) -> np.ndarray:
    """Presence rows as floats; rows of bytes are packed bits."""
    return np.unpackbits(present, axis=1).astype(np.float32) if present.dtype == np.uint8 else present


def fit(present: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = 0.1) -> LanguageModel:
    """Kernel ridge regression, one language against the rest, on a Nyström map of presence rows (floats, or packed bits)."""
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((FEATURES, 0), np.float32), np.zeros(0, np.float32))
    n = len(present)
    chosen = normalised(_floats(present[np.linspace(0, n - 1, min(landmarks, n)).astype(int)]))
    values, vectors = np.linalg.eigh((chosen @ chosen.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    to_map = vectors[:, good] / np.sqrt(values[good])
    kernel = np.concatenate([normalised(_floats(present[at : at + BLOCK])) @ chosen.T for at in range(0, n, BLOCK)])
    mapped = kernel.astype(np.float64) @ to_map
    y = np.where(np.array(labels)[:, None] == np.array(languages), 1.0, -1.0)
    middle, mean = mapped.mean(axis=0), y.mean(axis=0)
    z = mapped - middle
    w = np.linalg.solve(z.T @ z + ridge * np.eye(z.shape[1]), z.T @ (y - mean))
    parts = [chosen[:, at : at + 1024].T @ (to_map @ w) for at in range(0, FEATURES, 1024)]  # a product with doubles copies its floats
    return LanguageModel(languages, np.concatenate(parts).astype(np.float32), (mean - middle @ w).astype(np.float32))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's decimal text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, landmarks: int = LANDMARKS) -> LanguageModel:
    """Learn from at most per_language labelled rows of each language that aren't held out."""
    rows = only(docs, doc_id=quoted(id_col), text=quoted(text_col), lang=quoted(lang_col).cast("string"))
    usable = rows.filter("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").filter(~held_out(F.col("doc_id"))).withColumn("key", F.xxhash64("text"))
    # of a large language only a few times per_language distinct rows, those of small hash, are ranked: no task sorts a whole language
    once = usable.select("doc_id", "lang", "key").distinct().withColumn("h", F.pmod(F.xxhash64("doc_id", "key"), F.lit(1 << 40)))
    sizes = once.groupBy("lang").agg(F.count("*").alias("n"))
    near = once.join(sizes, "lang").filter(F.col("h") <= F.lit(float(1 << 40)) * 4 * per_language / F.col("n"))
    by = Window.partitionBy("lang").orderBy("h", "doc_id", "key")
    picked = near.withColumn("k", F.row_number().over(by)).filter(F.col("k") <= per_language).select("doc_id", "lang", "key")
    taken = picked.limit(per_language * MOST_LANGUAGES + 1).collect()
    if len(taken) > per_language * MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    keys = docs.sparkSession.createDataFrame(taken, picked.schema)  # bounded: per_language rows a language

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in slices(batches, 64, 2):
            packed = np.packbits(presence(part.column(2).to_pylist()).astype(bool), axis=1)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in packed], pa.binary())], names=["doc_id", "lang", "bits"])

    lowered = usable.join(F.broadcast(keys), ["doc_id", "lang", "key"], "left_semi").dropDuplicates(["doc_id", "lang", "key"]).select("doc_id", "lang", F.lower("text").cast("binary").alias("data"))
    id_type = usable.schema["doc_id"].dataType.simpleString()
    found = lowered.mapInArrow(bits, f"doc_id {id_type}, lang string, bits binary").collect()
    found.sort(key=lambda r: (r["doc_id"], r["lang"], bytes(r["bits"])))
    packed = np.frombuffer(b"".join(bytes(r["bits"]) for r in found), np.uint8).reshape(len(found), FEATURES // 8)
    return fit(packed, [r["lang"] for r in found], landmarks)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """The input rows with lang_pred and score added (columns of those names are replaced); only the text is looked at."""
    languages = model.languages
    kept = [c for c in docs.columns if c not in (pred_col, score_col)]
    letters = F.coalesce(quoted(text_col).rlike(r"\p{L}"), F.lit(False))
    data = free_name(docs, "data")
    rows = docs.select(*map(quoted, kept), F.when(letters, F.lower(quoted(text_col)).cast("binary")).alias(data))
    schema = docs.select(*map(quoted, kept), F.lit("").alias(pred_col), F.lit(0.0).alias(score_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64, len(kept)):
            texts = part.column(part.num_columns - 1).to_pylist()
            pred, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if t is not None]
            if known and languages:
                raw = model.scores([texts[i] for i in known])
                pred[known] = np.array(languages, object)[raw.argmax(axis=1)]
                score[known] = np.clip((raw.max(axis=1) + 1) / 2, 0, 1)
            columns = [part.column(i) for i in range(part.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*kept, pred_col, score_col])

    return map_rows(rows, run, schema)
