"""SimHash near-dedup with bit-sliced comparison.

1. A fingerprint of each whole text: words and shingle hashes in built-in functions, bit majorities
   in numpy batches.
2. Equal fingerprints become one node. Two fingerprints that differ in at most RADIUS = 3 bits
   agree on two of five bit blocks, so each node enters ten tables under the value of two blocks
   (about 26 bits). Values that only one node has are left out by a count.
3. Buckets lie side by side in bit planes, 64 fingerprints a word, and meet themselves shifted:
   differences are added by carry-save counters, and blocks are abandoned once every distance
   exceeds the radius. Buckets over CHUNK nodes are cut into chunks and every pair of chunks is a
   bucket of its own, so no task gets more than two chunks of one key. A bucket sends a spanning
   forest of its links, not pairs.
4. Components of the links; a document's component_id is the smallest doc_id in its component.

Defined cases: null or blank text has fingerprint zero, which links like any other; fewer words
than a shingle: the whole sequence is the shingle; repeated rows are equal nodes; null doc_ids get
a fingerprint and the component of the known ids it reaches (null if none); an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, only, release, slices, stored, whole_text
from .components import components

RADIUS = 3
#: Bit widths of the five blocks; any two agree for a pair within the radius.
BLOCKS = (13, 13, 13, 13, 12)
CHUNK = 4096
SPACE = r"[ \t\n\u000B\f\r]+"


def shingle_hashes(text: Column, words: int = 3) -> Column:
    """XXH64 (seed 42) of each shingle of lower-cased (A-Z) words, as signed longs."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = F.filter(F.split(lower, SPACE), lambda w: w != "")
    def hashes(ws: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(ws) - (words - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(ws, i, words), " ")))
    # one-element transforms bind the word array, so that it isn't split again for every shingle
    return F.element_at(F.transform(F.array(split), lambda ws: F.when(F.size(ws) == 0, F.array().cast("array<bigint>")).otherwise(hashes(ws))), 1)


def majority_bits(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each run of hashes that ends at ends[i]: a word whose bit is 1 where over half the run's bits are."""
    starts = np.concatenate([[0], ends[:-1]])
    out = np.zeros(len(ends), np.uint64)
    full = np.flatnonzero(ends > starts)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    step = 1 << 14  # hashes unpacked at a time, in whole runs or parts of one
    counts = np.zeros((len(ends), 64), np.int64)
    for at in range(0, len(hashes), step):
        part = hashes[at : at + step]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first, last = np.searchsorted(ends, at, "right"), np.searchsorted(ends, at + len(part) - 1, "right")
        rows = full[(full >= first) & (full <= last)]
        counts[rows] += np.add.reduceat(bits, np.maximum(starts[rows] - at, 0), axis=0, dtype=np.int64)
    over = counts * 2 > (ends - starts)[:, None]
    out[full] = (over[full] * weights).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long, for every row."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024, 1):
            lists = batch.column(1)
            ends = np.asarray(lists.offsets)[1:].astype(np.int64) - lists.offsets[0].as_py()
            fps = majority_bits(np.asarray(lists.flatten()).astype(np.int64).view(np.uint64), ends)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    rows = only(docs, doc_id=F.col(id_col).cast("long"), hashes=shingle_hashes(whole_text(text_col), words))
    return rows.mapInArrow(reduce, "doc_id long, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """Planes of fingerprints of one or more words (n, or n x words); bit j of word k of plane i is bit i of fingerprint 64k + j."""
    wide = fps.reshape(len(fps), -1)
    padded = np.zeros((-(-len(fps) // 64) * 64, wide.shape[1]), np.uint64)
    padded[: len(fps)] = wide
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def carry_save(planes: np.ndarray) -> list[np.ndarray]:
    """How many planes are set in each lane, as planes of the counts' bits, lowest first: full adders over thirds of the rows."""
    counts, rows = [], planes
    while len(rows):
        carries = [rows[:0]]
        while len(rows) > 1:
            third = len(rows) // 3
            if third:
                a, b, c = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third]
                odd = a ^ b
                carries.append(a & b | odd & c)
                rows = np.concatenate([odd ^ c, rows[3 * third :]])
            else:
                carries.append(rows[:1] & rows[1:])
                rows = rows[:1] ^ rows[1:]
        counts.append(rows[0])
        rows = np.concatenate(carries)
    return counts


def _added(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """The sum of two bit-sliced numbers."""
    out, carry = [], None
    for k in range(max(len(a), len(b))):
        x, y = (n[k] if k < len(n) else np.zeros_like(a[0]) for n in (a, b))
        odd = x ^ y
        out.append(odd if carry is None else odd ^ carry)
        carry = x & y if carry is None else x & y | odd & carry
    return [*out, carry]


def _more(counts: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count is over the radius."""
    same, more = ~np.uint64(0), np.zeros_like(counts[0])
    if radius >> len(counts):  # no count reaches it
        return more
    for k in reversed(range(len(counts))):
        if radius >> k & 1:
            same = same & counts[k]
        else:
            more, same = more | same & counts[k], same & ~counts[k]
    return more


def near_lanes(planes: np.ndarray, wanted: np.ndarray, shift: int, radius: int) -> np.ndarray:
    """Lanes i of `wanted` (a flag a lane) whose fingerprint is within radius of that of lane i + shift.

    The planes meet themselves shifted; carry-save counters hold all distances bit by bit, and after every part
    of the planes the blocks (words of 64 lanes) in which every wanted lane is over the radius are abandoned.
    """
    flags = np.zeros(planes.shape[1] * 64, bool)
    flags[: len(wanted)] = wanted
    mask = np.packbits(flags, bitorder="little").view("<u8")
    live = np.flatnonzero(mask)
    mask, (jump, bits) = mask[live], divmod(shift, 64)
    step, counts, last = max(16, len(planes) // 4), None, planes.shape[1] - 1
    for at in range(0, len(planes), step):
        part = planes[at : at + step]
        there = part[:, np.minimum(live + jump, last)]
        if bits:
            there = there >> np.uint64(bits) | part[:, np.minimum(live + jump + 1, last)] << np.uint64(64 - bits)
        found = carry_save(part[:, live] ^ there)
        counts = found if counts is None else _added(counts, found)
        mask = mask & ~_more(counts, radius)
        stay = np.flatnonzero(mask)
        if len(stay) < len(live):
            live, mask, counts = live[stay], mask[stay], [c[stay] for c in counts]
        if not len(live):
            return live
    lanes = np.unpackbits(mask.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, bit = np.nonzero(lanes)
    return live[word] * 64 + bit


def spanning_links(fps: np.ndarray, ends: np.ndarray, radii: tuple[int, ...] = (RADIUS,), accept: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Edges (positions) that span the links inside every group of fps; groups lie side by side and end at `ends`.

    All groups, small and large, share the planes: lane i meets i + 1, i + 2, ... as far as its group reaches.
    Narrow radii come first, so that the closest links are the ones found; a group in one piece is done.
    """
    planes, n = bit_planes(fps), len(fps)
    sizes = np.diff(ends, prepend=0)
    group, end, lane = np.repeat(np.arange(len(ends)), sizes), np.repeat(ends, sizes), np.arange(n)
    root, pieces, edges = np.arange(n), sizes.copy(), []
    for radius in radii:
        for shift in range(1, int(sizes.max(initial=0))):
            wanted = (lane + shift < end) & (pieces[group] > 1)
            if not wanted.any():
                break
            at = near_lanes(planes, wanted, shift, radius)
            at = at[root[at] != root[at + shift]]
            if accept is not None and len(at):
                at = at[accept(at, at + shift)]
            for i in at.tolist():
                a, b = i, i + shift
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                if a != b:
                    root[max(a, b)] = min(a, b)
                    pieces[group[i]] -= 1
                    edges.append((i, i + shift))
            while len(at) and (root[root] != root).any():
                root = root[root]
    return edges


def crossing_links(fps: np.ndarray, ends: np.ndarray, part: np.ndarray, radius: int, accept: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All links inside groups between positions of different parts."""
    planes, lane = bit_planes(fps), np.arange(len(fps))
    sizes = np.diff(ends, prepend=0)
    end = np.repeat(ends, sizes)
    for shift in range(1, int(sizes.max(initial=0))):
        wanted = lane + shift < end
        wanted[: len(fps) - shift] &= part[: len(fps) - shift] != part[shift:]
        at = near_lanes(planes, wanted, shift, radius)
        at = at[accept(at, at + shift)] if len(at) else at
        if len(at):
            yield at, at + shift


def _bucket_keys(fp: Column) -> Column:
    """An array of ten table keys: the table's number and the values of its two blocks."""
    parts, at = [], 0
    for width in BLOCKS:
        parts.append(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)))
        at += width
    keys = [F.lit(t << 32).bitwiseOR(F.shiftleft(parts[i], 13)).bitwiseOR(parts[j]) for t, (i, j) in enumerate(combinations(range(5), 2))]
    return F.array(*keys)


def links(nodes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) of fingerprints within the radius, enough to span every component; nodes: distinct fp."""
    placed = nodes.select("fp", F.explode(_bucket_keys(F.col("fp"))).alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    n_chunks = F.ceil(F.col("n") / F.lit(chunk)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), n_chunks).cast("int")
    other = F.explode(F.sequence(F.lit(0), n_chunks - 1))
    shared = (
        placed.join(sizes, "bucket").select("fp", "bucket", mine.alias("c"), other.alias("o"))
        .select("fp", "bucket", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ends in _groups(batches):
            fps = np.ascontiguousarray(rows[:, 2])
            found = np.array(spanning_links(fps.view(np.uint64), ends), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(fps[found[:, 0]]), pa.array(fps[found[:, 1]])], names=["a", "b"])

    pair = (F.col("lo").cast("long") * (1 << 31) + F.col("hi")).alias("pair")
    dealt = shared.select("bucket", pair, "fp").repartition("bucket", "pair").sortWithinPartitions("bucket", "pair", "fp")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, chunk: int = CHUNK) -> DataFrame:
    """doc_id, fp, component_id for every row."""
    marked = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    linked = stored(components(links(nodes.select("fp"), chunk)).withColumnRenamed("node", "fp"), "components")
    roots = linked.join(nodes, "fp")
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    known = roots.select("fp", "root").join(least, "root").select("fp", F.col("component_id").alias("linked_id"))
    # stored, so that the last join has two plain exchanges and adaptive execution can split a hot fingerprint
    named = stored(nodes.join(known, "fp", "left").select("fp", F.coalesce("linked_id", "least").alias("component_id")), "named")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """The input rows, all columns: of each component the smallest doc_id stays (rows without an id stay)."""
    decided = stored(near_duplicates(docs, id_col, text_col, words), "near-decided")
    lost = stored(decided.filter("doc_id != component_id").select(F.col("doc_id").alias("__lost")).distinct(), "near-lost")
    return docs.join(checked_broadcast(lost, 16), docs[id_col] == lost["__lost"], "left_anti")


def _mixed(x: np.ndarray, by: int) -> np.ndarray:
    """A permutation of 64-bit words, another one for every `by`."""
    x = x * np.uint64(int(np.random.default_rng(by).integers(1 << 62, 1 << 63)) | 1)
    x ^= x >> np.uint64(32)
    return x


#: Tables of the wide search, least hashes that make a table's key, words of the wide fingerprint.
TABLES, ROWS, WIDE = 24, 4, 4
#: Bits of 256 in which sets at 0.8 differ at most (39 on average; 48 for the smallest sets, with deviation 6), after two narrower passes.
RADII = (28, 50, 80)


def marks_of(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every run of hashes: WIDE fingerprint words with a byte of each of TABLES * ROWS least hashes behind them, and TABLES keys."""
    starts = np.concatenate([[0], ends[:-1]])
    full = np.flatnonzero(ends > starts)
    least = np.zeros((len(ends), TABLES * ROWS), np.uint64)
    fps = np.zeros((len(ends), WIDE), np.uint64)
    if len(full):
        for t in range(TABLES * ROWS):
            least[full, t] = np.minimum.reduceat(_mixed(hashes, t), starts[full])
        for w in range(WIDE):
            fps[:, w] = majority_bits(_mixed(hashes, 1000 + w), ends)
    keys = np.zeros((len(ends), TABLES), np.uint64)
    for t in range(TABLES):
        for r in range(ROWS):
            keys[:, t] = _mixed(keys[:, t] ^ least[:, t * ROWS + r], 2000 + r)
        keys[:, t] ^= np.uint64(int(np.random.default_rng(3000 + t).integers(1 << 62, 1 << 63)))
    return np.concatenate([fps.astype("<u8").view(np.uint8), (least & np.uint64(255)).astype(np.uint8)], axis=1), keys


def _sets(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, text_key (a hash of the text), node (the hash of all shingles) and shingles (distinct, ascending)."""
    text = whole_text(text_col)
    rows = only(docs, doc_id=F.col(id_col).cast("long"), text_key=F.xxhash64(text), shingles=F.sort_array(F.array_distinct(shingle_hashes(text, words))))
    return rows.select("doc_id", "text_key", F.xxhash64("shingles").alias("node"), "shingles")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of longs that are sorted by their first two columns, in runs of whole groups, with the groups' ends."""
    rest: np.ndarray | None = None
    for batch in batches:
        rows = np.stack([np.asarray(c) for c in batch.columns], axis=1)
        rows = rows if rest is None else np.concatenate([rest, rows])
        cut = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
        if len(cut):
            yield rows[: cut[-1]], cut
            rows = rows[cut[-1] :]
        rest = rows
    if rest is not None and len(rest):
        yield rest, np.array([len(rest)])


def _list_parts(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column of lists of longs."""
    ends = np.asarray(column.offsets).astype(np.int64) - column.offsets[0].as_py()
    return np.split(np.asarray(column.flatten()), ends[1:-1]) if len(column) else []


def _marked_groups(batches: Iterator[pa.RecordBatch], longs: int = 3) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list[np.ndarray]]]]:
    """Rows, ends, wide fingerprints, least-hash bytes and lists of runs of whole groups; columns are longs, the mark, lists."""
    held: list[np.ndarray] = []
    lists: list[list[np.ndarray]] = []

    def plain() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held.append(np.frombuffer(b"".join(batch.column(longs).to_pylist()), np.uint8).reshape(batch.num_rows, WIDE * 8 + TABLES * ROWS))
            lists.extend([] for _ in range(batch.num_columns - longs - 1 - len(lists)))
            for k, one in enumerate(lists):
                one.extend(_list_parts(batch.column(longs + 1 + k)))
            yield pa.RecordBatch.from_arrays(batch.columns[:longs], names=batch.schema.names[:longs])

    for rows, ends in _groups(plain()):
        marks, n = np.concatenate(held), len(rows)
        held[:] = [marks[n:]]
        mine = [one[:n] for one in lists]
        for one in lists:
            del one[:n]
        yield rows, ends, np.ascontiguousarray(marks[:n, : WIDE * 8]).view("<u8"), marks[:n, WIDE * 8 :], mine


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two ascending arrays share."""
    a, b = (a, b) if len(a) < len(b) else (b, a)
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, chunk: int = CHUNK // 2) -> DataFrame:
    """doc_id, text_key, component_id for every row: components of texts whose shingle sets have a Jaccard likeness of `least` or more.

    Equal sets are one node. Sets at 0.8 differ in up to a third of their fingerprint's bits, for which no blocks of
    bits both agree surely and tell texts apart; so a table's key is made of four least hashes of the set (equal with
    chance 0.8 each, 24 tables: a pair at 0.8 is missed by 3 in a million). In a bucket 256-bit fingerprints are
    compared bit-sliced, near ones pass if the least hashes agree about enough, and every link is verified on the
    sets themselves. First a forest of each bucket's closest links is verified; buckets where one failed get the
    sets of their members, and there all other near pairs between different components are verified in place (each
    in the first bucket that both share), so that a failed link hides none and no pairs but links leave a bucket.
    """
    floor = max(least - 0.2, 0.0)  # five deviations of a mean of 96

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, 512, 3):
            lists = batch.column(3)
            ends = np.asarray(lists.offsets)[1:].astype(np.int64) - lists.offsets[0].as_py()
            marks, keys = marks_of(np.asarray(lists.flatten()).astype(np.int64).view(np.uint64), ends)
            full = np.diff(ends, prepend=0) > 0
            offsets = np.concatenate([[0], np.where(full, TABLES, 0).cumsum()]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[full].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([m.tobytes() for m in marks], pa.binary()), listed], names=["doc_id", "text_key", "node", "mark", "keys"])

    marked = stored(_sets(docs, id_col, text_col, words).mapInArrow(mark, "doc_id long, text_key long, node long, mark binary, keys array<long>"), "similar-marked")
    nodes = stored(marked.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("mark").alias("mark"), F.first("keys").alias("keys")), "similar-nodes")
    placed = nodes.select("node", F.explode("keys").alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    n_chunks = F.ceil(F.col("n") / F.lit(chunk)).cast("int")
    mine = F.pmod(F.xxhash64("node"), n_chunks).cast("int")
    pair = (F.least("c", "o").cast("long") * (1 << 31) + F.greatest("c", "o")).alias("pair")
    shared = placed.join(sizes, "bucket").select("bucket", "node", mine.alias("c"), F.explode(F.sequence(F.lit(0), n_chunks - 1)).alias("o"))
    shared = stored(shared.select("bucket", pair, "node").join(nodes.select("node", "mark"), "node"), "similar-shared")

    def alike(bytes_: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        return lambda i, j: (bytes_[i] == bytes_[j]).mean(axis=1) >= floor

    def spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ends, fps, bytes_, _ in _marked_groups(batches):
            found = np.array(spanning_links(fps, ends, RADII, alike(bytes_)), np.int64).reshape(-1, 2)
            columns = (rows[found[:, 0], 0], rows[found[:, 0], 1], rows[found[:, 0], 2], rows[found[:, 1], 2])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "pair", "a", "b"])

    def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ends, fps, bytes_, (keys, sets) in _marked_groups(batches, 4):
            keys_, part, found = np.stack(keys), rows[:, 3].copy(), []
            sizes = np.array([len(x) for x in sets])
            before = np.cumsum(keys_ == rows[:, :1], axis=1) == 0  # the tables before this bucket's own
            close = alike(bytes_)

            def likely(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                sized = np.minimum(sizes[i], sizes[j]) >= least * np.maximum(sizes[i], sizes[j])  # noqa: B023
                first = ~((keys_[i] == keys_[j]) & before[i]).any(axis=1)  # noqa: B023
                return sized & first & close(i, j)  # noqa: B023

            root: dict[int, int] = {}

            def top(x: int) -> int:
                while x in root:  # noqa: B023
                    x = root[x]  # noqa: B023
                return x

            for at, to in crossing_links(fps, ends, part, RADII[-1], likely):
                for i, j in zip(at.tolist(), to.tolist(), strict=True):
                    a, b = top(int(part[i])), top(int(part[j]))
                    if a == b:
                        continue
                    shared_ = _common(sets[i], sets[j])
                    if shared_ / (sizes[i] + sizes[j] - shared_) >= least:
                        root[max(a, b)] = min(a, b)
                        found.append((rows[i, 2], rows[j, 2]))
            columns = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(columns[:, 0]), pa.array(columns[:, 1])], names=["a", "b"])

    low_high = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]

    def sets_of(named: DataFrame, name: str) -> DataFrame:
        """node, shingles of stored distinct nodes, from the texts again."""
        ids = named.join(nodes, "node").select(F.col("least").alias("__id")).distinct()
        known = docs.select(F.col(id_col).cast("long").alias("__doc"), F.col(text_col).alias("__text"))
        chosen = known.join(ids, F.col("__doc").eqNullSafe(F.col("__id")), "left_semi")
        return stored(_sets(chosen, "__doc", "__text", words).select("node", "shingles").join(named, "node", "left_semi").dropDuplicates(["node"]), name)

    def verified(edges: DataFrame) -> DataFrame:
        """a, b, good for stored distinct edges (a, b): a forest of each bucket, so fewer than its rows."""
        named = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
        sets = sets_of(stored(named, "similar-named"), "similar-sets")
        side = lambda k: sets.select(F.col("node").alias(k), F.col("shingles").alias(f"s{k}"))
        both = edges.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common"))
        return stored(both.select("a", "b", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common")) >= F.lit(least)).alias("good")), "similar-verified")

    order = ("bucket", "pair", "node")
    dealt = shared.select(*order, "mark").repartition("bucket", "pair").sortWithinPartitions(*order)
    found = stored(dealt.mapInArrow(spanning, "bucket long, pair long, a long, b long").select("bucket", "pair", *low_high), "similar-found")
    tried = verified(stored(found.select("a", "b").distinct(), "similar-tried"))
    links_ = tried.filter("good").select("a", "b")
    joined = stored(components(links_), "similar-components")
    failed = tried.filter("NOT good")
    if failed.limit(1).count():
        open_ = found.join(failed, ["a", "b"], "left_semi").select("bucket", "pair").distinct()
        again = stored(shared.join(open_, ["bucket", "pair"], "left_semi").join(joined, "node", "left").select(*order, F.coalesce("root", "node").alias("root"), "mark"), "similar-again")
        sets = sets_of(stored(again.select("node").distinct(), "similar-open"), "similar-open-sets")
        again = again.join(sets.join(nodes.select("node", "keys"), "node"), "node").select(*order, "root", "mark", "keys", "shingles")
        more = again.repartition("bucket", "pair").sortWithinPartitions(*order).mapInArrow(crossing, "a long, b long")
        links_ = stored(links_.union(more.select(*low_high)).distinct(), "similar-links")
        joined = stored(components(links_), "similar-components")
    roots = joined.join(nodes.select("node", "least"), "node")
    smallest = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = roots.select("node", "root").join(smallest, "root").select("node", F.col("component_id").alias("linked_id"))
    named = stored(nodes.join(linked, "node", "left").select("node", F.coalesce("linked_id", "least").alias("component_id")), "similar-components-named")
    return marked.select("doc_id", "text_key", "node").join(named, "node").select("doc_id", "text_key", "component_id")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """The input rows, all columns: of each component of similar() the smallest doc_id stays (rows without an id stay)."""
    decided = similar(docs, id_col, text_col, words, least).filter("doc_id != component_id")
    lost = stored(decided.select(F.col("doc_id").alias("__lost"), F.col("text_key").alias("__lost_text")).distinct(), "similar-lost")
    same = (docs[id_col] == lost["__lost"]) & (F.xxhash64(whole_text(text_col)) == lost["__lost_text"])
    return docs.join(checked_broadcast(lost, 24), same, "left_anti")
