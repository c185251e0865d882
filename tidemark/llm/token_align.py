"""Which tokens of two tokenizers cover the same bytes, and how often corpus-wide, by exact-text deduplication.

Method. Documents are grouped by their full text (a counting aggregate, so copies are merged before the shuffle).
Each distinct text is tokenised and aligned once: both tokenizers' byte ends are merged, every stretch between
neighbouring ends belongs to one token of each and is a link, and ends that both share cut groups. A pair's count is
the number of documents that hold it: each distinct text adds its number of copies. Measures go back to doc_ids by the
text's SHA-256.

Plan. Aligned texts are stored in blocks of about BLOCK_PAIRS distinct pairs. A block sends each of its pairs once,
with the number of its documents; pairs are summed and joined back to the blocks that asked for them, and a block's
texts meet their counts in one task. So neither all pairs nor all texts are in one place, a common pair costs a row a
block, and nothing is broadcast.

Inside a task a text is cut where a character that isn't white space meets a blank or line feed. No token of either
vocabulary crosses such a place (`Aligner` checks that of the files; with other files texts stay whole), so a chunk's
alignment is the same in every text, and a bounded memo keeps it. Chunks of the byte-level vocabulary are encoded by
merge ranks, which gives the library's ids if every token of the vocabulary encodes to itself (`ranks_agree` checks
it): when two neighbours that make up a token meet, the library would, from that token's bytes alone, pass through the
same two neighbours and end in the token. A text whose chunks don't give back its bytes goes to both libraries whole.

Defined cases: a null or empty text, and one that either tokenizer doesn't give back byte by byte, has no tokens: zeros
and an empty groups_sha256. Null and repeated ids stay, a row each; each row counts as a document. An empty table gives
no rows. Very long texts are one row of a block. Columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import KEPT, map_rows, only, release, slices, stored, whole_text

#: Chunks that a worker remembers at most, and their characters.
MEMO_LIMIT, MEMO_CHARS = 400_000, 8_000_000
#: Longer chunks are merged by the library, whose time doesn't grow with the square of a run of letters.
LONG = 200
#: Distinct pairs of texts after which a block ends.
BLOCK_PAIRS = 1 << 20
# Fixed rule of byte-level pre-tokenizers: where a text is cut before merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}

CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: Texts for which putting a mark before every blank and line feed isn't the same as CUT.
ODD = re.compile(r"\s[ \n]|^\s|\x00")
ALIGNED = "digest binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, block long, pairs binary, times binary"
SEPARATORS = ",|;\n"
_aligners: dict[tuple, "Aligner"] = {}
KEPT.append(_aligners.clear)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from U+0100 on."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = count(256)
    return {chr(b if b in printing else next(free)): b for b in range(256)}


def _rules(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def ranks_agree(path: str) -> bool:
    """Whether merging by rank gives this file's ids: its rules are plain byte-level BPE, and every token encodes to itself."""
    from tokenizers import Tokenizer

    rules = _rules(path)
    model, vocab = rules["model"], rules["model"].get("vocab", {})
    plain = rules.get("normalizer") is None and rules.get("pre_tokenizer") == PRE_TOKENIZER and model["type"] == "BPE" and not any(
        model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    letters = set(byte_letters())
    special = {t["content"] for t in rules.get("added_tokens", [])}
    own = [t for t in vocab if t not in special]
    if not plain or any(set(t) - letters for t in own) or not letters <= set(own):
        return False
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if sorted((vocab[a + b] for a, b in merges)) != [vocab[a + b] for a, b in merges]:
        return False
    bare = Tokenizer.from_file(path)
    bare.pre_tokenizer = None
    bare.encode_special_tokens = True
    return all(e.ids == [vocab[t]] for e, t in zip(bare.encode_batch(own, add_special_tokens=False), own, strict=True))


class Grown:
    """A numpy array that grows at its end."""

    def __init__(self, dtype: str):
        self.data, self.n = np.zeros(1024, dtype), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(max(self.n, len(values)) + len(values), self.data.dtype)])
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class Aligner:
    """Both tokenizers of a worker, and what it remembers of chunks."""

    def __init__(self, path_a: str, path_b: str, by_rank: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if set(token) <= letters.keys() else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.ranks = None
        if by_rank:
            special = set(self.a.get_added_tokens_decoder())
            self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={x: i for i, x in enumerate(self.bytes_a) if i not in special}, special_tokens={})
        self.space = self.b.piece_to_id("▁")
        # pieces that reach over a place where texts are cut
        over = any(re.search("[^▁]▁|[ \n]", p) for p in pieces) or self.b.encode("\n")[:1] != [self.space]
        self.cuts = by_rank and not over
        self.len_a, self.len_b = (np.array(list(map(len, t)), np.int64) for t in (self.bytes_a, self.bytes_b))
        self.base = len(self.bytes_b)
        self.dtype = np.dtype("<u4") if len(self.bytes_a) * self.base <= 1 << 32 else np.dtype("<u8")
        width = max(len(self.bytes_a), len(self.bytes_b))
        self.names, self.width = np.array([f"{i}{s}" for s in SEPARATORS for i in range(width)], object), width
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []
        self.good, self.counts, self.starts, self.pairs = Grown("?"), [Grown("i8") for _ in range(4)], Grown("i8"), Grown("i8")

    def cut(self, text: str) -> list[str]:
        """Chunks of a blank and the text."""
        if not self.cuts:
            return [" " + text]
        if ODD.search(text):
            return CUT.split(" " + text)
        return (" " + text.replace("\n", "\0\n").replace(" ", "\0 ")).split("\0")

    def ids_a(self, chunks: list[str], whole: bool) -> list[list[int]]:
        if self.ranks is None or whole:
            return [e.ids for e in self.a.encode_batch(chunks, add_special_tokens=False)]
        encode = self.ranks.encode_ordinary
        return [encode(c) if len(c) <= LONG else self.a.encode(c, add_special_tokens=False).ids for c in chunks]

    def ids_b(self, chunks: list[str]) -> list[list[int]]:
        """A leading blank is the one that the library puts before a text; before a line feed it is taken off again."""
        found = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        return [i[1:] if c[0] != " " else i for c, i in zip(chunks, found, strict=True)]

    def learn(self, chunks: list[str], whole: bool = False) -> None:
        """Add chunks to what is remembered, in this order."""
        a, b = self.ids_a(chunks, whole), self.ids_b(chunks)
        raw = [c.encode() for c in chunks]
        flat_a, flat_b = (list(chain.from_iterable(x)) for x in (a, b))
        size = np.array(list(map(len, raw)), np.int64)
        n_a, n_b = (np.array(list(map(len, x)), np.int64) for x in (a, b))
        joined = b"".join(raw)
        same = all(
            b"".join(map(table.__getitem__, flat)) == joined and np.array_equal(self._sums(lengths[flat], n), size)
            for table, lengths, flat, n in ((self.bytes_a, self.len_a, flat_a, n_a), (self.bytes_b, self.len_b, flat_b, n_b)))
        if not same:  # those that aren't given back have no tokens
            good = [b"".join(map(self.bytes_a.__getitem__, x)) == r == b"".join(map(self.bytes_b.__getitem__, y)) for x, y, r in zip(a, b, raw, strict=True)]
            a, b, raw = ([x if g else x[:0] for x, g in zip(part, good, strict=True)] for part in (a, b, raw))
            flat_a, flat_b = (list(chain.from_iterable(x)) for x in (a, b))
            size = np.array(list(map(len, raw)), np.int64)
        self.good.add(np.array(good) if not same else np.ones(len(chunks), bool))
        self._align(np.array(flat_a, np.int64), np.array(flat_b, np.int64), np.cumsum(size))

    @staticmethod
    def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        ends = np.cumsum(lengths)
        return total[ends] - total[ends - lengths]

    def _align(self, a: np.ndarray, b: np.ndarray, chunk_ends: np.ndarray) -> None:
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        ends = np.union1d(ends_a, ends_b)
        in_a, in_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        both = ends[(ends_a[in_a] == ends) & (ends_b[in_b] == ends)] if len(ends) else ends
        before = np.concatenate([[0], chunk_ends[:-1]]) if len(chunk_ends) else chunk_ends
        for grown, marks in zip(self.counts, (ends_a, ends_b, both, ends), strict=True):
            grown.add(np.searchsorted(marks, chunk_ends, "right") - np.searchsorted(marks, before, "right"))
        links = self.counts[3].data[self.counts[3].n - len(chunk_ends) : self.counts[3].n]
        self.starts.add(self.pairs.n + np.cumsum(links) - links)
        self.pairs.add(a[in_a] * self.base + b[in_b])
        # every token's place in the text of all groups, and the character behind it
        of_a, of_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        upto_a, upto_b = np.searchsorted(ends_a, both, "right"), np.concatenate([[0], np.searchsorted(ends_b, both, "right")])
        last_a, last_b = both[of_a] == ends_a, both[of_b] == ends_b
        final = np.isin(ends_b, chunk_ends)
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + upto_b[of_a]] = a + self.width * last_a
        codes[np.arange(len(b)) + upto_a[of_b]] = b + self.width * np.where(final, 3, 2 * last_b)
        lines = "".join(self.names[codes].tolist()).split("\n")[:-1]
        if len(lines) < len(chunk_ends):  # chunks without tokens have no line
            rest = iter(lines)
            lines = [next(rest) if n else "" for n in links]
        self.groups += lines

    def batch(self, texts: list[str]) -> tuple[list[np.ndarray], list[str], np.ndarray, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups and n_links of each text, its groups, and (text, pair, times) of its distinct pairs in order."""
        if len(self.memo) > MEMO_LIMIT or self.chars > MEMO_CHARS:
            self.forget()
        parts = [self.cut(t) for t in texts]
        new = list(set().union(*parts).difference(self.memo))
        if new:
            self.memo.update(zip(new, range(len(self.groups), len(self.groups) + len(new)), strict=True))
            self.chars += sum(map(len, new))
            self.learn(new)
        numbers = [list(map(self.memo.__getitem__, p)) for p in parts]
        good = self.good.data
        if not good[: self.good.n].all():
            for k, own in enumerate(numbers):
                if not good[own].all():
                    numbers[k] = [len(self.groups)]
                    self.chars += len(texts[k])
                    self.learn([" " + texts[k]], whole=True)
        flat = np.fromiter(chain.from_iterable(numbers), np.int64)
        sizes = np.array(list(map(len, numbers)), np.int64)
        counts = [self._sums(c.data[flat], sizes) for c in self.counts]
        get = self.groups.__getitem__
        groups = [";".join(map(get, own)) for own in numbers]
        # a text's chunks once each with their times, then its pairs
        keys, times = np.unique(np.repeat(np.arange(len(texts)), sizes) << 40 | flat, return_counts=True)
        text, chunk = keys >> 40, keys & ((1 << 40) - 1)
        links = self.counts[3].data[chunk]
        at = np.repeat(self.starts.data[chunk] - (np.cumsum(links) - links), links) + np.arange(links.sum())
        span = len(self.bytes_a) * self.base
        wide = np.repeat(text, links) * span + self.pairs.data[at]
        order = np.argsort(wide, kind="stable")
        wide, weight = wide[order], np.repeat(times, links)[order]
        first = np.flatnonzero(np.concatenate([[True], wide[1:] != wide[:-1]])) if len(wide) else np.zeros(0, np.int64)
        summed = np.add.reduceat(weight, first) if len(first) else weight
        return counts, groups, wide[first] // span, wide[first] % span, summed


def aligner(path_a: str, path_b: str, by_rank: bool) -> Aligner:
    key = (path_a, path_b, by_rank)
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def align_texts(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """ALIGNED, a row a distinct text: the measures of its tokens, and its distinct pairs (a * size of b's vocabulary + b) with their times.

    with_groups adds `groups`, the ids of each group as text. path_a: a byte-level vocabulary of the tokenizers library; path_b: a sentencepiece model.
    """
    by_rank = ranks_agree(path_a)
    schema = StructType.fromDDL(ALIGNED + (", groups string" if with_groups else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(path_a, path_b, by_rank)
        block, held = TaskContext.get().partitionId() << 32, 0
        for part in slices(batches, rows=2048, column=0, most=2 << 20):
            texts = part.column(0).to_pylist()
            counts, groups, text, pair, times = tool.batch(texts)
            cuts = np.searchsorted(text, np.arange(len(texts) + 1))
            pair, times = pair.astype(tool.dtype), times.astype("<u4")
            columns: list = [[hashlib.sha256(t.encode()).digest() for t in texts], part.column(1), *counts, [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]]
            blocks, ranges = [], [(cuts[k], cuts[k + 1]) for k in range(len(texts))]
            for s, e in ranges:
                blocks.append(block)
                held += int(e - s)
                if held >= BLOCK_PAIRS:
                    block, held = block + 1, 0
            columns += [blocks, [pair[s:e].tobytes() for s, e in ranges], [times[s:e].tobytes() for s, e in ranges]] + ([groups] if with_groups else [])
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=schema.names)
        release(kept=False)

    distinct = only(docs, text=whole_text(text_col)).filter("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    return map_rows(distinct, run, schema)


def _dtype(path_a: str, path_b: str) -> tuple[np.dtype, int]:
    """How pairs are stored, and the size of b's vocabulary."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = max(Tokenizer.from_file(path_a).get_vocab(with_added_tokens=True).values()) + 1
    b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    return np.dtype("<u4") if a * b <= 1 << 32 else np.dtype("<u8"), b


def block_pairs(aligned: DataFrame, dtype: np.dtype) -> DataFrame:
    """block, pair, n: the documents of a block that hold the pair. A block that two tasks read gives rows from both."""
    schema = StructType.fromDDL("block long, pair long, n long")

    def summed(block: int, copies: list[int], parts: list[bytes]) -> pa.RecordBatch:
        pairs = np.frombuffer(b"".join(parts), dtype).astype(np.int64)
        weight = np.repeat(np.array(copies, np.int64), [len(p) // dtype.itemsize for p in parts])
        order = np.argsort(pairs, kind="stable")
        pairs, weight = pairs[order], weight[order]
        first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
        n = np.add.reduceat(weight, first) if len(first) else weight
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), block)), pa.array(pairs[first]), pa.array(n)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, copies, parts = None, [], []
        for part in slices(batches, rows=2048, column=2, most=8 << 20):
            for block, n, pairs in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if block != now:
                    if parts:
                        yield summed(now, copies, parts)
                    now, copies, parts = block, [], []
                copies.append(n)
                parts.append(pairs)
        if parts:
            yield summed(now, copies, parts)
        release(kept=False)

    return map_rows(aligned.select("block", "copies", "pairs"), run, schema)


def pair_counts(by_block: DataFrame, size_b: int) -> DataFrame:
    """pair, n (documents that hold it, corpus-wide), best (no pair of the same first token has more)."""
    summed = by_block.groupBy("pair").agg(F.sum("n").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.expr(f"pair div {size_b}")))  # a token has at most size_b partners
    return summed.withColumn("best", F.col("n") == most)


MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def text_measures(aligned: DataFrame, by_block: DataFrame, size_b: int, dtype: np.dtype) -> DataFrame:
    """digest and all measures of every distinct text: a block's texts meet the counts of the block's pairs."""
    asked = by_block.select("block", "pair").join(pair_counts(by_block, size_b), "pair").select("block", "pair", "n", "best")
    schema = StructType.fromDDL("digest binary, " + ", ".join(f"{m} long" for m in MEASURES) + ", groups_sha256 string")

    def meet(texts: pa.Table, counts: pa.Table) -> pa.Table:
        texts, counts = texts.combine_chunks(), counts.combine_chunks()
        known = counts.column("pair").to_numpy()
        order = np.argsort(known, kind="stable")
        known, n, best = known[order], counts.column("n").to_numpy()[order], counts.column("best").to_numpy()[order]
        raw, times = texts.column("pairs").to_pylist(), texts.column("times").to_pylist()
        sizes = np.array([len(r) // dtype.itemsize for r in raw], np.int64)
        at = np.searchsorted(known, np.frombuffer(b"".join(raw), dtype).astype(np.int64))
        weight = np.frombuffer(b"".join(times), "<u4").astype(np.int64)
        sums = [Aligner._sums(weight * x[at] if len(at) else weight, sizes) for x in (best.astype(np.int64), n)]
        columns = {"digest": texts.column("digest"), **{m: texts.column(m) for m in MEASURES[:4]}, "n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1]), "groups_sha256": texts.column("groups_sha256")}
        return pa.table(columns)

    rows = aligned.select("block", "digest", *MEASURES[:4], "groups_sha256", "pairs", "times")
    return rows.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(meet, schema)


def alignment_measures(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and measures of every document: tokens of both, groups, links, links that are a token's commonest, the links' counts summed, and the groups' digest."""
    dtype, size_b = _dtype(path_a, path_b)
    aligned = stored(align_texts(docs, path_a, path_b, text_col), "aligned-texts")
    by_block = stored(block_pairs(aligned, dtype), "block-pairs")
    found = text_measures(aligned, by_block, size_b, dtype)
    mine = only(docs, id=id_col, digest=F.unhex(F.sha2(F.col(text_col).cast("binary"), 256)))
    rows = mine.join(found, "digest", "left")
    return rows.select(F.col("id").alias(id_col), *[F.coalesce(m, F.lit(0)).alias(m) for m in MEASURES], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
