"""Alignment of two tokenizers, sharded Lloyd rounds and the threshold algorithm against brute force."""

import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import queries, sharded_lloyd, threshold_search, token_align

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
_a = Tokenizer.from_file(BYTES)
_a.encode_special_tokens = True
_b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
_tool = token_align.Aligner(BYTES, PIECES, True)
NONE = (0, 0, [], [])


def plainly(text):
    """n_a, n_b, groups and links by loops over the libraries' tokens."""
    full = (" " + text).encode()
    a, b = _a.encode(" " + text, add_special_tokens=False).ids, _b.encode(text)
    raw_a, raw_b = [_tool.bytes_a[i] for i in a], [_tool.bytes_b[i] for i in b]
    if not text or b"".join(raw_a) != full or b"".join(raw_b) != full:
        return NONE
    of = []
    for ids, raw in ((a, raw_a), (b, raw_b)):
        at, owner = 0, []
        for k, r in enumerate(raw):
            owner += [k] * len(r)
            at += len(r)
        of.append((owner, ids))
    links = sorted(set(zip(of[0][0], of[1][0], strict=True)))
    groups, left, right = [], [], []
    ends_a, ends_b = set(np.cumsum([len(r) for r in raw_a]).tolist()), set(np.cumsum([len(r) for r in raw_b]).tolist())
    for at in range(1, len(full) + 1):
        if at in ends_a:
            left.append(a[of[0][0][at - 1]])
        if at in ends_b:
            right.append(b[of[1][0][at - 1]])
        if at in ends_a and at in ends_b:
            groups.append(f"{','.join(map(str, left))}|{','.join(map(str, right))}")
            left, right = [], []
    return len(a), len(b), groups, [(a[i], b[j]) for i, j in links]


def measured(texts):
    """What alignment_measures() gives for rows of these texts, by loops over all of them."""
    known = {t: plainly(t or "") for t in set(texts)}
    counts, most, out = Counter(), defaultdict(int), []
    for t in texts:
        counts.update(set(known[t][3]))
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    for t in texts:
        n_a, n_b, groups, links = known[t]
        out.append((n_a, n_b, len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_equals_loops(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op11_token_align(spark, sf).collect()
    assert got[0].__fields__[0] == "doc_id" and len(got) == len(rows)
    want = {r.doc_id: m for r, m in zip(rows, measured([r.text for r in rows]), strict=True)}
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in got} == want


def test_alignment_of_odd_rows_and_small_blocks(spark, odd, odd_rows, empty, monkeypatch):
    monkeypatch.setattr(token_align, "BLOCK_PAIRS", 40)
    got = sorted(((r.doc_id, *(r[c] for c in COLUMNS)) for r in token_align.alignment_measures(odd, BYTES, PIECES).collect()), key=str)
    assert got == sorted(((r[0], *m) for r, m in zip(odd_rows, measured([r[1] for r in odd_rows]), strict=True)), key=str)
    assert token_align.alignment_measures(empty, BYTES, PIECES).count() == 0
    groups = token_align.align_texts(odd.filter("text = 'one two'"), BYTES, PIECES, with_groups=True).first()
    assert groups.groups == ";".join(plainly("one two")[2]) and groups.copies == 1


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.text(alphabet="aBé漢 .,'s \n\t\r\x00\x1c\x85\xa0 　▁<|>_1😀́ﬁ᠎​", min_size=1, max_size=40), min_size=1, max_size=4))
def test_chunks_align_as_whole_texts(texts):
    counts, groups, text, pair, times = _tool.batch(texts)
    for k, t in enumerate(texts):
        n_a, n_b, cut, links = plainly(t)
        mine = text == k
        assert ([int(c[k]) for c in counts], groups[k]) == ([n_a, n_b, len(cut), len(links)], ";".join(cut))
        assert dict(zip(zip((pair[mine] // _tool.base).tolist(), (pair[mine] % _tool.base).tolist(), strict=True), times[mine].tolist(), strict=True)) == Counter(links)


def test_merging_by_rank_is_only_for_files_that_allow_it(tmp_path):
    assert token_align.ranks_agree(BYTES) and not token_align.ranks_agree(public_tokenizers.path("word_bpe_49k.json"))
    whole = token_align.Aligner(BYTES, PIECES, False)
    assert whole.cut("a b") == [" a b"]
    assert whole.batch(["a b\nc"])[1] == _tool.batch(["a b\nc"])[1]


def test_a_full_memo_starts_again(monkeypatch):
    monkeypatch.setattr(token_align, "MEMO_LIMIT", 3)
    tool = token_align.Aligner(BYTES, PIECES, True)
    for text in ("one two three four five", "two six", "one two three", "y" * 500):
        assert tool.batch([text])[1] == [";".join(plainly(text)[2])]
        assert len(tool.memo) <= 8


VECTORS = "vec_id long, embedding array<float>, cluster string, `at` int, label int"


def vector_rows():
    r = np.random.default_rng(3)
    near = (r.normal(size=(7, 64)) * 0.2)[r.integers(0, 7, 400)] + r.normal(size=(400, 64)) * 0.05
    rows = [(i * 5, near[i].astype(np.float32).tolist(), "clash", 1, 0) for i in range(400)]
    rows += [rows[0], rows[0], rows[10], (None, rows[3][1], "x", 1, 0), (1001, None, "x", 1, 0), (1002, [], "x", 1, 0), (1003, [0.5] * 63, "x", 1, 0), (1004, [0.5] * 63 + [None], "x", 1, 0),
             (1005, [math.nan] * 64, "x", 1, 0), (1006, [math.inf] + [0.0] * 63, "x", 1, 0), (1007, [1e30] + [0.0] * 63, "x", 1, 0), (1050, [0.0] * 64, "x", 1, 0), (1100, [-x for x in rows[7][1]], "x", 1, 0)]
    return rows


def integers(vector, dims=None):
    if vector is None or any(x is None or not math.isfinite(x) or abs(x) * 256 > 1 << 27 for x in vector) or dims not in (None, len(vector)):
        return None
    return [math.floor(256 * float(x)) for x in vector]


def lloyd_plainly(rows, clusters, rounds):
    kept = [(r[0], v) for r in rows if (v := integers(r[1], 64)) is not None]
    x = np.array([v for _, v in kept], np.int64).reshape(-1, 64)
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, hashlib.sha256(f"2:{kept[k][0]}".encode()).hexdigest(), kept[k][1]))[:clusters]
    c = x[order].copy()
    for n in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        near = d.argmin(1)
        for j in range(len(c) if n < rounds else 0):
            if (near == j).any():
                c[j] = np.floor_divide(x[near == j].sum(0), (near == j).sum())
    least = d.min(1)
    return sorted(((i, int(j), int(e), int(least[near == j].sum()), int(least.sum()), hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest()) for (i, _), j, e in zip(kept, near, least, strict=True)), key=str)


def test_lloyd_equals_loops(spark):
    rows = vector_rows()
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    assert sorted(map(tuple, sharded_lloyd.clustered(df, clusters=9, rounds=3).collect()), key=str) == lloyd_plainly(rows, 9, 3)
    few = rows[:3] + rows[-8:]
    assert sorted(map(tuple, sharded_lloyd.clustered(spark.createDataFrame(few, VECTORS), clusters=9, rounds=2).collect()), key=str) == lloyd_plainly(few, 9, 2)
    got = sharded_lloyd.clustered(spark.createDataFrame([], VECTORS), rounds=1)
    assert got.count() == 0 and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_small_chunks_and_other_shards_give_the_same(spark):
    kept = sharded_lloyd.kept_vectors(spark.createDataFrame(vector_rows(), VECTORS).repartition(2), 64, 256)
    found = []
    for shards, chunk in ((4, 2048), (3, 50), (1, 7)):
        slices = sharded_lloyd.initial_slices(kept, 6, 64, "2:", shards)
        moved = sharded_lloyd.next_slices(sharded_lloyd.column_blocks(kept, 64, shards, chunk), slices).orderBy("shard").collect()
        found.append(np.concatenate([np.array(r.slices).reshape(r.k, -1) for r in moved], axis=1).tolist())
    assert found[0] == found[1] == found[2]


def top_plainly(rows, k):
    kept = [(n, r[0], v) for n, r in enumerate(rows) if (v := integers(r[1])) is not None]
    out = []
    for n, name, q in kept:
        if name is not None and name % 50 == 0:
            others = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), i is None, i or 0) for m, i, v in kept if m != n)[:k]
            out += [(name, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(others, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "blocks", "queries_", "stride"), [(8192, 2, 1024, 32), (16, 3, 4, 1), (50, 1, 1, 7)])
def test_threshold_search_equals_loops(spark, monkeypatch, block, blocks, queries_, stride):
    for name, value in (("BLOCK", block), ("BLOCKS", blocks), ("QUERIES", queries_), ("STRIDE", stride)):
        monkeypatch.setattr(threshold_search, name, value)
    rows = vector_rows()
    got = threshold_search.top_k(spark.createDataFrame(rows, VECTORS).repartition(3), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect()), key=str) == top_plainly(rows, 5)


def test_threshold_search_of_few_rows_and_large_numbers(spark):
    ask = F.col("vec_id") % 50 == 0
    assert threshold_search.top_k(spark.createDataFrame([], VECTORS), ask).count() == 0
    assert threshold_search.top_k(spark.createDataFrame([(50, [1.0], "", 0, 0)], VECTORS), ask).count() == 0
    big = 400_000.0
    rows = [(50, [big, -big], "", 0, 0), (51, [big, -big], "", 0, 0), (52, [big, -big + 0.03125], "", 0, 0), (53, [big], "", 0, 0), (100, [], "", 0, 0)]
    assert sorted(map(tuple, threshold_search.top_k(spark.createDataFrame(rows, VECTORS), ask).collect()), key=str) == top_plainly(rows, 5)


def test_a_walk_stops_before_the_block_is_seen():
    """The best lie in front of every list, so the bound falls below them at once."""
    x = np.zeros((4096, 4), np.int64)
    x[:5] = 1000
    x[5:, 0] = -np.arange(4091)
    lists = np.argsort(-x, axis=0, kind="stable").T
    seen = []
    block = threshold_search.Block(0, list(range(4096)), x.astype("<i4").tobytes(), np.ascontiguousarray(lists, "<i4").tobytes(), 4, 5)

    class Watched(np.ndarray):
        def __getitem__(self, key):
            seen.append(np.size(key[0]) if isinstance(key, tuple) else np.size(key))
            return np.asarray(self)[key]

    block.x = block.x.view(Watched)
    assert [t[2] for t in block.walk(np.array([5, 5, 5, 5]), None, 5, None)] == [0, 1, 2, 3, 4]
    assert sum(seen) < 400


@pytest.mark.parametrize("name", ["op12_sharded_lloyd", "op13_threshold_top5"])
def test_vector_queries_equal_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, sf)
    assert got.columns == columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
