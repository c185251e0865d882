"""A corpus pipeline of five stages; each takes what the one before it wrote.

language ID -> exact dedup -> SimHash near-dedup -> personal data -> best-fit packing

Defined cases: null ids stay, but language ID doesn't learn from them and near-dedup neither drops nor keeps others by
them; null, empty and letterless texts go with the first stage; rows that repeat id and text are one; an empty table
gives no rows; extra columns, whatever their names, go along to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, language_id, packing, pii, simhash
from tidemark.llm.common import free_name, quoted, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without text or letters are rejected and go.

    The classifier learns from the stage's own input, from rows that aren't held out.
    """
    model = language_id.train(docs)
    lang, score = free_name(docs, "predicted"), free_name(docs, "likeness")
    seen = language_id.predict(docs, model, pred_col=lang, score_col=score)
    return seen.filter(quoted(lang) != language_id.UNKNOWN).select(*map(quoted, docs.columns))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id."""
    return exact_dedup.drop_exact_copies(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8 or more): the one with the smallest id."""
    return simhash.drop_similar(docs, words=5, least=0.8)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind, n_chars as of the new text."""
    return pii.redact(docs, length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)


ARROW_ROWS = 1000
STAGES = [("language_id", language), ("exact_dedup", exact), ("simhash", near), ("pii", private), ("best_fit_packing", pack)]

#: No SQL: packing and the language model can't be put in it; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to shared scratch and read again.

    Texts go to Python ARROW_ROWS at a time, a setting of the session: very long ones come in thousands.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
