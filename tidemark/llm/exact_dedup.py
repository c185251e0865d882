"""Exact dedup by a log-structured merge index of digests, in DataFrame operations only.

* memtable: the rows of one task; it flushes as one *run*, a Parquet file sorted by digest (level 0);
* compaction: merges the runs that came since the last one, and level 1, into a new level 1: one row a
  digest with the identifier that stays (``keep``: the largest or the smallest) and the number of
  copies, sorted runs again, with a filter beside them;
* filter: a bit map of the digests that hit more than once, FILTER_BITS bits a digest, made and probed in
  built-in functions. `hits` of rows asks it before it joins level 1, so rows that hit nothing, nearly
  all, are dropped inside the scan and only the others meet the run;
* verification: digests that hit more than once get their bytes compared, by grouping on digest
  *and* text. Copies are combined inside each task first, so a group that holds a third of all
  rows sends one row a task. Digests under which different texts meet are split by text.

Only digests and identifiers of documents are shuffled, and the texts of hits.

Defined cases: null text is the empty text; null identifiers rank below all others; rows that
repeat both identifier and text are one document in two rows, both get the same answer; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_LIMIT, checked_broadcast, free_name, only, quoted, scratch_path, stored, whole_text

FILTER_BITS = 16


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def digest_place(bits: int) -> Column:
    """The bit of a digest, from 1, in a filter of so many bits."""
    return F.pmod(F.xxhash64("digest"), F.lit(bits)) + 1


class DigestIndex:
    """Sorted digest runs under one folder; `add` flushes runs, `compact` merges them, `hits` asks them."""

    def __init__(self, spark, path: str | None = None, keep: str = "largest"):
        if keep not in ("largest", "smallest"):
            raise ValueError("keep is 'largest' or 'smallest'")
        self.spark, self.keep = spark, keep
        self.path = path or scratch_path(spark, "digest-index")
        self.flushed, self.merged, self.level1, self.repeats, self.filter, self.bits = 0, 0, None, None, None, 64

    def add(self, entries: DataFrame) -> None:
        """Flush entries (doc_id, digest): each task is a memtable and leaves one sorted run."""
        entries.sortWithinPartitions("digest", "doc_id").write.parquet(f"{self.path}/level0/flush={self.flushed}")
        self.flushed += 1

    def entries(self, since: int = 0) -> DataFrame:
        """Entries of all runs, or of those flushed since."""
        return self.spark.read.parquet(*[f"{self.path}/level0/flush={k}" for k in range(since, self.flushed)])

    def compact(self) -> DataFrame:
        """One row a digest: keep_id, group_size, and keep_rows, the rows that share keep_id. Only new runs and the old level 1 are read."""
        best = F.max if self.keep == "largest" else F.min
        rank = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "n")
        if self.keep == "smallest":
            rank = F.struct(F.col("doc_id").isNull().alias("known"), "doc_id", "n")
        fresh = self.entries(self.merged).groupBy("digest", "doc_id").agg(F.count("*").alias("n"), F.count("*").alias("size"))
        if self.level1 is not None:
            old = self.level1.select("digest", F.col("keep_id").alias("doc_id"), F.col("keep_rows").alias("n"), F.col("group_size").alias("size"))
            fresh = fresh.unionByName(old).groupBy("digest", "doc_id").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
        merged = (
            fresh.groupBy("digest").agg(best(rank).alias("b"), F.sum("size").alias("group_size"))
            .select("digest", F.col("b.doc_id").alias("keep_id"), "group_size", F.col("b.n").alias("keep_rows"))
        )
        path = f"{self.path}/level1-{self.flushed}"
        merged.sortWithinPartitions("digest").write.parquet(path)
        self.level1, self.merged = self.spark.read.parquet(path), self.flushed
        self.repeats = stored(self.level1.filter("group_size > 1").select("digest"), "digest-hits")
        self.bits = max(64, self.repeats.count() * FILTER_BITS)
        self.filter = None
        if self.bits <= BROADCAST_LIMIT * 8:  # a filter that no task can hold helps no scan
            place = digest_place(self.bits)
            self.filter = stored(self.repeats.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("map")), "digest-filter")
        return self.level1

    def hits(self, rows: DataFrame) -> DataFrame:
        """Rows (with a column digest) whose digest the index holds more than once: the filter first, then the run."""
        if self.filter is not None:
            place, name = digest_place(self.bits), free_name(rows, "part")
            byte = F.conv(F.hex(F.substring("map", F.floor(F.bitmap_bit_position(place) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            bit = F.floor(byte / F.pow(F.lit(2), F.bitmap_bit_position(place) % 8)).cast("int") % 2
            asked = rows.withColumn(name, F.bitmap_bucket_number(place)).join(F.broadcast(self.filter.withColumnRenamed("part", name)), name)
            rows = asked.filter(bit == 1).select(*map(quoted, rows.columns))
        return rows.join(checked_broadcast(self.repeats, 64), "digest", "left_semi")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest",
                digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    """One row per input row: doc_id, digest, keep_id, group_size, keep_rows, kept.

    digest may be any deterministic binary function: verification keeps the result exact.
    """
    rows = only(docs, doc_id=id_col, text=whole_text(text_col)).withColumn("digest", digest(F.col("text")))
    index = DigestIndex(docs.sparkSession, keep=keep)
    index.add(rows.select("doc_id", "digest"))
    level1 = index.compact()

    classes = index.hits(rows).groupBy("digest", "text").agg(F.lit(1).alias("one"))
    mixed = stored(classes.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest"), "digest-mixed")

    columns = ["doc_id", "digest", "keep_id", "group_size", "keep_rows"]
    entries = index.entries()
    if mixed.count():
        mixed_rows = rows.join(mixed, "digest", "left_semi")
        best = F.max if keep == "largest" else F.min
        known = F.col("doc_id").isNotNull() if keep == "largest" else F.col("doc_id").isNull()
        by_text = (
            mixed_rows.groupBy("digest", "text", "doc_id").agg(F.count("*").alias("n"))
            .groupBy("digest", "text").agg(best(F.struct(known.alias("known"), "doc_id", "n")).alias("b"), F.sum("n").alias("group_size"))
            .select("digest", "text", F.col("b.doc_id").alias("keep_id"), "group_size", F.col("b.n").alias("keep_rows"))
        )
        split = mixed_rows.join(by_text, ["digest", "text"]).select(columns)
        out = entries.join(mixed, "digest", "left_anti").join(level1, "digest").select(columns).unionByName(split)
    else:
        out = entries.join(level1, "digest").select(columns)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The input rows, all columns, without copies: of equal texts one row stays."""
    decided = stored(exact_dedup(docs, id_col, text_col, keep), "digest-decided")
    name = free_name(docs, "key")
    marked = docs.withColumn(name, F.struct(F.col(id_col), sha256_digest(whole_text(text_col))))
    as_key = F.struct(F.col("doc_id").alias(id_col), F.col("digest"))
    lost = stored(decided.filter("NOT kept").select(as_key.alias("lost")).distinct(), "digest-lost")
    twice = stored(decided.filter("kept AND keep_rows > 1").select(as_key.alias("lost")).distinct(), "digest-twice")

    def keyed(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        return df.join(checked_broadcast(keys, 96), df[name].eqNullSafe(keys["lost"]), how)

    left = keyed(marked, lost, "left_anti")
    if twice.count():
        left = keyed(left, twice, "left_anti").unionByName(keyed(left, twice, "left_semi").dropDuplicates([name]))
    return left.drop(name)
