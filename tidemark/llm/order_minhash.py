"""Order MinHash fingerprints, in DataFrame functions only.

A text's words form k-mers of WORDS words. Each k-mer is numbered among its equals in text order,
so a repeated k-mer counts as often as it occurs, and the pair (k-mer, number) is hashed. The hash's
top bits pick one of BINS bins (one permutation serves all of them); in each bin the PICKED smallest
pairs are selected, put back into text order, and the tuple of their hashes is hashed. The
fingerprint is the list of these values, the bin in each value's top bits, so moving text about
changes it where a bag of k-mers would not. Likeness is the share of bins with equal values among
bins that either text fills.

The edited-text job moves each text once: rows are dealt by ranges of the id, and of the text's hash
where one id or null has many rows; the first row of every range also goes, as a guest, to the end of
the range before it, and a lead over each range then sees every row's follower. The driver holds some
numbers a range of RANGE_BYTES; in the plan they are a few constants, searched by halving.

Defined cases: null text is the empty text, whose fingerprint is the empty string; two empty
fingerprints are alike to 1, one empty to 0; fewer words than WORDS: the whole sequence is the only
k-mer; rows that repeat an id follow one another in order of their text's hash; null ids come last;
a single row follows itself; an empty table gives no rows; other columns are ignored. Positions
count modulo 2^24 words.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, whole_text

WORDS = 5
BIN_BITS = 5
PICKED = 2
POSITION_BITS = 24
#: Text that a range of ids holds at most, on average.
RANGE_BYTES = 32 << 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and use it in body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _numbered(kmers: Column) -> Column:
    """Structs (h, n, i) of k-mer hash, number among equals and position; linear after one sort."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda j: (j == 1) | (F.get(s, j - 1)["h"] != F.get(s, F.greatest(j - 2, F.lit(0)))["h"]))

        def spread(b: Column) -> Column:
            ends = F.concat(F.slice(b, F.lit(2), F.size(b)), F.array(F.size(s) + 1))
            one = lambda q: F.transform(F.sequence(q["from"], q["to"] - 1), lambda j: F.struct(F.get(s, j - 1)["h"].alias("h"), (j - q["from"] + 1).alias("n"), F.get(s, j - 1)["i"].alias("i")))
            return F.flatten(F.transform(F.arrays_zip(b.alias("from"), ends.alias("to")), one))

        return let(starts, spread)

    return let(F.sort_array(F.transform(kmers, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), runs)


def _packed(h: Column, n: Column, i: Column) -> Column:
    """A pair's hash with its position in the low bits: sorting sorts by bin, then by hash."""
    low = (1 << POSITION_BITS) - 1
    return F.xxhash64(h, n).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long").bitwiseAND(F.lit(low)))


def _bin(x: Column) -> Column:
    return F.shiftright(x, 64 - BIN_BITS)


def fingerprint(text: Column, words: int = WORDS, picked: int = PICKED) -> Column:
    """The values of the filled bins, an array of longs in bin order."""
    low, top = (1 << POSITION_BITS) - 1, 64 - BIN_BITS
    # in the split, runs of blanks are one blank and the ends have none
    tidy = F.trim(F.regexp_replace(text, r"\s+", " "))

    def kmers(hashes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(hashes) - (words - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, words)))

    def pairs(k: Column) -> Column:
        simple = F.transform(k, lambda h, i: _packed(h, F.lit(1), i))
        general = F.transform(_numbered(k), lambda s: _packed(s["h"], s["n"], s["i"]))
        return F.sort_array(F.when(F.size(F.array_distinct(k)) == F.size(k), simple).otherwise(general))

    def pick(a: Column) -> Column:
        return F.filter(a, lambda x, j: (j < picked) | (_bin(F.get(a, F.greatest(j - picked, F.lit(0)))) != _bin(x)))

    def tuples(s: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda j: (j == 1) | (_bin(F.get(s, F.greatest(j - 2, F.lit(0)))) != _bin(F.get(s, j - 1))))

        def value(j: Column) -> Column:
            own = F.filter(F.slice(s, j, picked), lambda x: _bin(x) == _bin(F.get(s, j - 1)))
            ordered = F.sort_array(F.transform(own, lambda x: F.struct(x.bitwiseAND(F.lit(low)).alias("p"), x.bitwiseAND(F.lit(~low)).alias("h"))))
            mixed = F.xxhash64(F.transform(ordered, lambda o: o["h"]))
            return F.shiftrightunsigned(mixed, BIN_BITS).bitwiseOR(F.shiftleft(_bin(F.get(s, j - 1)), top))

        return F.transform(firsts, value)

    hashes = F.transform(F.split(tidy, " "), lambda w: F.xxhash64(w))
    made = let(let(let(let(hashes, kmers), pairs), pick), tuples)
    return F.when(tidy == "", F.array().cast("array<bigint>")).otherwise(made)


def as_text(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Equal values over bins that a or b fills, 1 for two empty fingerprints."""
    bins = F.array_union(F.transform(a, _bin), F.transform(b, _bin))
    return F.when(F.size(bins) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(bins)).cast("double")


def _constant(values: list[int | None]) -> Column:
    """An array of longs that is one literal in the plan, however long."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _up_to(cuts: list[int], x: Column) -> Column:
    """How many of the ascending cuts are at most x, by halving steps."""
    at = _constant(cuts)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(at, n + step - 1) <= x, n + step).otherwise(n)) if cuts else F.lit(0)


def _ranges(rows: DataFrame, n: int) -> Column:
    """The range of each row, of about n, ascending in the order of rows: falling doc_id, null last, then the text's hash.

    An id that holds more rows than a range, and null ids, get ranges by the hash; only rows equal in both always lie together.
    """
    shares = [i / n for i in range(1, n)]
    cut_at = F.percentile_approx("doc_id", shares, max(10_000, 8 * n)) if shares else F.lit(None)
    found, total, nulls = rows.agg(cut_at, F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    heavy = {c: k for c, k in Counter(found or []).items() if k > 1}
    # a cut and the one after it leave an id alone in its range
    cuts = sorted({*(found or []), *[c + 1 for c in heavy if c < (1 << 63) - 1]})
    parts = [1, *[heavy.get(c, 1) for c in cuts]][::-1]  # the last range has the smallest ids
    parts.append(max(1, round(n * nulls / max(total, 1))))
    starts = [0, *accumulate(parts)][:-1]
    rank = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - _up_to(cuts, F.col("doc_id")))
    split = F.get(_constant(parts), rank)
    part = F.least(F.floor((F.xxhash64("text") / F.lit(2.0**64) + 0.5) * split), split - 1)
    return (F.get(_constant(starts), rank) + part).cast("int")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, picked: int = PICKED) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text has its last floor(n/2) characters replaced by as many first ones (or all) of the
    next text in descending id order; the last row's next is the first.
    """
    spark = docs.sparkSession
    rows = only(docs, doc_id=F.col(id_col).cast("long"), text=whole_text(text_col))
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 2, -(-volume // RANGE_BYTES))
    rows = rows.withColumn("home", _ranges(rows, n))
    # the first row of each range, and the range before it, whose last row it follows; a row a range
    lead = F.struct("doc_id", F.bitwise_not(F.xxhash64("text")).alias("turned"))
    firsts = rows.groupBy("home").agg(F.max(lead).alias("f")).orderBy("home").collect()
    known = {r["home"]: (r["f"]["doc_id"], r["f"]["turned"], firsts[k - 1]["home"]) for k, r in enumerate(firsts)}
    ids, turned, before = (_constant([known.get(h, (None,) * 3)[c] for h in range(max(known, default=0) + 1)]) for c in range(3))
    own = F.struct(F.col("home").alias("at"), F.lit(0).alias("guest"))
    visits = F.struct(F.get(before, F.col("home")).cast("int").alias("at"), F.lit(1).alias("guest"))
    leads = F.col("doc_id").eqNullSafe(F.get(ids, F.col("home"))) & (F.bitwise_not(F.xxhash64("text")) == F.get(turned, F.col("home")))
    dealt = rows.select("doc_id", "text", F.explode(F.when(leads, F.array(own, visits)).otherwise(F.array(own))).alias("s")).select("doc_id", "text", "s.at", "s.guest")
    placed = dealt.repartition(max(len(firsts), 1), "at").withColumn("n_chars", F.length("text").cast("long")).withColumn("fp", fingerprint(F.col("text"), words, picked))
    order = Window.partitionBy("at").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    paired = placed.withColumn("next_text", F.lead("text").over(order)).withColumn("next_fp", F.lead("fp").over(order)).filter("guest = 0")
    edited = paired.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    efp = edited.withColumn("edited_fp", fingerprint(F.col("edited"), words, picked))
    return efp.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
                      likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
