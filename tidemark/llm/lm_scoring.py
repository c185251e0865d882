"""Documents scored by masked pseudo-likelihood.

A bidirectional window network predicts each token from SIDE tokens before and SIDE after it, never
from itself; a document's score is the sum of the conditional log-probabilities.

* tokens: lower-cased words, told apart by 64-bit hashes made in built-in functions;
* counts of every word over all documents, a table in shared scratch that grows with the words;
* classes: their number grows with the square root of the number of words. A word that makes up more than
  two parts in CLASSES of all tokens has a class of its own (so at most half of them have); the others
  are dealt to the rest by hash. A word's probability is its class's, from the network, times its
  share of the class: its count in other documents plus PRIOR, over the class's count plus PRIOR for
  each of its words and one unseen. So a word that no other document has scores below one that some has;
* counts of common words (each over one part in HELD of all tokens, so fewer than HELD) go along with the classes, and
  their shares are found in place; those of all others come by a join on the word, which so has no hot keys;
* network: one table of HIDDEN numbers a side position and class, added and squashed, then a softmax
  over groups of classes and one over the classes of a group. Every task trains a copy on all tokens
  of its rows, from the same start, and the copies are averaged by tokens: the model grows from the
  whole corpus, and depends a little on how rows are dealt to tasks.

Driver and tasks hold the classes (the root of the words) and the common words, never all words.

Defined cases: null or blank text has no tokens, log_prob 0 and per_token null; positions past the
ends of a text are a class of their own; repeated rows and null ids stay, each a document of its own;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, slices, stored, whole_text

HIDDEN = 16
SIDE = 2
HELD = 1 << 16
BATCH = 128  # tokens of a training step, for each group of classes
PRIOR = 0.1
FARTHEST = 40.0  # e to that power, times the groups, is a 32-bit number
FEWEST = 8  # groups of classes, and classes in a group


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def softmax(z: np.ndarray) -> np.ndarray:
    """Of each row, in place; numbers past FARTHEST count as that far."""
    np.clip(z, -FARTHEST, FARTHEST, out=z)
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[1], z.dtype))[:, None]
    return z


def order_of(values: np.ndarray, most: int) -> np.ndarray:
    """A stable order; short integers are sorted by their digits."""
    return np.argsort(values.astype(np.uint16) if most < 1 << 16 else values, kind="stable")


@dataclass
class WindowNet:
    side: np.ndarray  # 2*SIDE x (classes + 1) x hidden; the last class is "outside"
    top: np.ndarray  # hidden x groups
    top_bias: np.ndarray
    low: np.ndarray  # groups x hidden x classes of a group
    low_bias: np.ndarray

    @staticmethod
    def start(groups: int, hidden: int = HIDDEN, seed: int = 7) -> "WindowNet":
        rng = np.random.default_rng(seed)

        def some(*shape: int) -> np.ndarray:
            return rng.normal(0, 0.1, shape).astype(np.float32)

        return WindowNet(some(2 * SIDE, groups * groups + 1, hidden), some(hidden, groups), np.zeros(groups, np.float32), some(groups, hidden, groups), np.zeros((groups, groups), np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.side, self.top, self.top_bias, self.low, self.low_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def filled(self, flat: np.ndarray) -> "WindowNet":
        cuts = np.cumsum([p.size for p in self.parts()])[:-1]
        return WindowNet(*[f.astype(np.float32).reshape(p.shape) for f, p in zip(np.split(flat, cuts), self.parts(), strict=True)])

    def hidden(self, around: np.ndarray) -> np.ndarray:
        h = np.take(self.side[0], around[0], axis=0)
        for o in range(1, len(around)):
            h += np.take(self.side[o], around[o], axis=0)
        return np.tanh(h, out=h)

    def by_group(self, target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        """An order of tokens by the group of their class, and each group met with its part of that order."""
        groups = len(self.top_bias)
        group = target // groups
        ends = np.cumsum(np.bincount(group, minlength=groups)).tolist()
        return order_of(group, groups), [(g, slice(a, b)) for g, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if b > a]

    def log_class(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each target class given the classes around it (2*SIDE x n)."""
        order, parts = self.by_group(target)
        group, member = np.divmod(target[order], len(self.top_bias))
        h = self.hidden(around[:, order])
        each = np.arange(len(order))
        chance = softmax(h @ self.top + self.top_bias)[each, group].astype(float)
        for g, part in parts:
            chance[part] *= softmax(h[part] @ self.low[g] + self.low_bias[g])[each[: part.stop - part.start], member[part]]
        out = np.empty(len(order))
        out[order] = np.log(np.maximum(chance, 1e-60))
        return out

    def learn(self, around: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One gradient step on a batch."""
        n, classes = len(target), self.side.shape[1]
        order, parts = self.by_group(target)
        around = around[:, order]
        group, member = np.divmod(target[order], len(self.top_bias))
        h, each = self.hidden(around), np.arange(n)
        p = softmax(h @ self.top + self.top_bias)
        p[each, group] -= 1
        g = p @ self.top.T
        self.top -= rate / n * (h.T @ p)
        self.top_bias -= rate / n * p.sum(axis=0)
        for k, part in parts:
            near, many = h[part], part.stop - part.start
            p = softmax(near @ self.low[k] + self.low_bias[k])
            p[each[:many], member[part]] -= 1
            g[part] += p @ self.low[k].T
            step = rate / max(many, 64)
            self.low[k] -= step * (near.T @ p)
            self.low_bias[k] -= step * p.sum(axis=0)
        np.multiply(h, h, out=h)
        g *= np.subtract(1, h, out=h)
        for o in range(len(around)):
            order = order_of(around[o], classes)
            ranked = around[o][order]
            at = np.flatnonzero(np.diff(ranked, prepend=-1))
            self.side[o, ranked[at]] -= rate / n * 16 * np.add.reduceat(np.take(g, order, axis=0), at, axis=0)


def windows(classes: np.ndarray, ends: np.ndarray, outside: int) -> np.ndarray:
    """Classes at each side position, 2*SIDE x n, `outside` past the document's ends."""
    n = len(classes)
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    around = np.full((2 * SIDE, n), outside, classes.dtype)
    for k, o in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        if abs(o) < n:
            to, of = (slice(o, None), slice(None, -o)) if o > 0 else (slice(None, o), slice(-o, None))
            same = doc[to] == doc[of]
            around[k, of] = np.where(same, classes[to], outside)
    return around


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.asarray(column.offsets).astype(np.int64)
    return np.asarray(column.flatten()), offsets[1:] - offsets[0]


@dataclass
class Classes:
    """Which class a word is of, and the log of what a class's shares are divided by."""

    held: np.ndarray  # sorted hashes of the common words
    n: np.ndarray  # their counts
    own: np.ndarray  # their classes, -1 where they share one
    groups: int
    divisor: np.ndarray

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes of words, and places of the common ones in `held`, -1 for the others."""
        alone = int((self.own >= 0).sum())
        rest = alone + np.mod(hashes, self.groups**2 - alone)
        if not len(self.held):
            return rest, np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.held, hashes), len(self.held) - 1)
        at[self.held[at] != hashes] = -1
        own = np.where(at >= 0, self.own[at], -1)
        return np.where(own >= 0, own, rest), at


@dataclass
class Model:
    counts: DataFrame  # word, n, shared class; a stored table
    classes: Classes
    net: WindowNet

    def sums(self, hashes: np.ndarray, ends: np.ndarray, counted: bool) -> np.ndarray:
        """Per document: log-probabilities of its tokens' classes and common words' shares, less what other words' are divided by."""
        classes, place = self.classes.of(hashes)
        around = windows(classes, ends, len(self.classes.divisor))
        out = np.zeros(len(ends))
        each = np.empty(len(hashes))
        for at in range(0, len(hashes), 8192):
            part = slice(at, at + 8192)
            each[part] = self.net.log_class(around[:, part], classes[part])
        each -= self.classes.divisor[classes]
        filled = np.flatnonzero(np.diff(ends, prepend=0))
        if len(filled):
            out[filled] = np.add.reduceat(each, np.concatenate([[0], ends[:-1]]).astype(np.int64)[filled])
        size = max(len(self.classes.held), 1)
        at = np.flatnonzero(place >= 0)
        at = at[self.classes.own[place[at]] < 0]
        key, times = np.unique(np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[at] * size + place[at], return_counts=True)
        others = self.classes.n[key % size] - (times if counted else 0)
        return out + np.bincount(key // size, weights=times * np.log(others + PRIOR), minlength=len(ends))

    def score(self, rows: DataFrame, counted: bool = True) -> DataFrame:
        """doc_id, n_tokens, log_prob, per_token of a stored table (row, doc_id, tokens); counted: the model's counts hold these rows."""
        model = Model(None, self.classes, self.net)

        def nets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, column=2):
                hashes, ends = _lists(batch.column(2))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends, prepend=0)), pa.array(model.sums(hashes, ends, counted))], names=["row", "doc_id", "n_tokens", "net"])

        def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, column=1):
                hashes, ends = _lists(batch.column(1))
                keep = np.flatnonzero(model.classes.of(hashes)[1] < 0)
                doc, word = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[keep], hashes[keep]
                order = np.lexsort((word, doc))
                doc, word = doc[order], word[order]
                first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])])) if len(doc) else np.empty(0, np.int64)
                times = np.diff(first, append=len(doc))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[first])), pa.array(word[first]), pa.array(times.astype(np.int32))], names=["row", "word", "times"])

        here = F.col("times") if counted else F.lit(0)
        others = F.coalesce(F.col("n"), F.lit(0)) - here
        words = rows.select("row", "tokens").mapInArrow(rare, "row long, word long, times int").join(self.counts.select("word", "n"), "word", "left")
        shares = words.groupBy("row").agg(F.sum(F.col("times") * F.log(others + PRIOR)).alias("shares"))
        total = F.col("net") + F.coalesce("shares", F.lit(0.0))
        scored = rows.select("row", "doc_id", "tokens").mapInArrow(nets, "row long, doc_id long, n_tokens long, net double").join(shares, "row", "left")
        return scored.select("doc_id", "n_tokens", total.alias("log_prob"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("per_token"))


def word_counts(rows: DataFrame) -> DataFrame:
    """word, n over all rows: added up in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=8192, column=0):
            word, n = np.unique(_lists(batch.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], names=["word", "n"])

    return rows.select("tokens").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def classes_of(counts: DataFrame, hold: int = HELD) -> Classes:
    """Classes from a stored table (word, n): FEWEST squared, or about the root of the number of words."""
    size = counts.agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).first()
    groups = max(FEWEST, math.ceil(size["words"] ** 0.25))
    tokens, most = size["tokens"] or 0, groups**2 // 2
    common = counts.filter(F.col("n") * max(hold, most) > tokens).select("word", "n").toPandas()  # fewer words than that can be so common
    common = common.sort_values(["n", "word"], ascending=[False, True])
    word, n = common["word"].to_numpy(np.int64), common["n"].to_numpy(np.int64)
    alone = int((n * most > tokens).sum())
    own = np.where(np.arange(len(n)) < alone, np.arange(len(n)), -1)
    order = np.argsort(word)
    divisor = np.full(groups**2, math.log(PRIOR))  # a class without words has its unseen word only
    divisor[:alone] = 0.0
    shared = counts.filter(F.col("n") * most <= tokens).groupBy((F.pmod("word", F.lit(groups**2 - alone).cast("long")) + alone).alias("class"))
    for r in shared.agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():  # a row a class
        divisor[r["class"]] = math.log(r["n"] + PRIOR * (r["words"] + 1))
    return Classes(word[order], n[order], own[order], groups, divisor)


def train(rows: DataFrame, rate: float = 0.5, hold: int = HELD) -> Model:
    """Counts, classes and network from a stored table with an array column `tokens` of word hashes."""
    counts = stored(word_counts(rows), "lm-words")
    classes = classes_of(counts, hold)
    first, batch_size = WindowNet.start(classes.groups), BATCH * classes.groups

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, seen = first.filled(first.flat()), 0
        for batch in slices(batches, rows=8192, column=0):
            hashes, ends = _lists(batch.column(0))
            target, _ = classes.of(hashes)
            around = windows(target, ends, classes.groups**2)
            for at in range(0, len(target), batch_size):
                part = slice(at, at + batch_size)
                net.learn(around[:, part], target[part], rate)
            seen += len(target)
        if seen:
            flat = net.flat().astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * seen), pa.array(np.full(len(flat), float(seen)))], names=["i", "w", "n"])

    summed = rows.select("tokens").mapInArrow(fit, "i int, w double, n double").groupBy("i").agg((F.sum("w") / F.sum("n")).alias("w")).toPandas()  # a row a parameter
    flat = first.flat()
    flat[summed["i"].to_numpy()] = summed["w"].to_numpy()
    return Model(counts, classes, first.filled(flat))


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stored table: row (unique), doc_id, tokens (hashes of words)."""
    return stored(only(docs, row=F.monotonically_increasing_id(), doc_id=F.col(id_col).cast("long"), tokens=word_hashes(whole_text(text_col))), "lm-tokens")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_prob, per_token (log_prob / n_tokens) for every row, by a model of these documents."""
    rows = hashed(docs, id_col, text_col)
    return train(rows).score(rows)
