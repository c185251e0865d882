"""Exact dedup, SimHash and Order MinHash against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, order_minhash, queries, simhash


def groups(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    return by


def expected_exact(rows, pick=max):
    by = groups(rows)
    out = []
    for i, t in rows:
        ids = by[t or ""]
        known = [x for x in ids if x is not None]
        keep = pick(known) if known else None
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep,pick", [("largest", max), ("smallest", min)])
@pytest.mark.parametrize("digest", [exact_dedup.sha256_digest, lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 3), 2, "0"))])
def test_exact_dedup(odd, odd_rows, keep, pick, digest):
    """The second digest has three values, so that byte verification has to split every group."""
    out = exact_dedup.exact_dedup(odd, keep=keep, digest=digest)
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out.collect()), key=str)
    assert got == sorted((e[:4] for e in expected_exact([r[:2] for r in odd_rows], pick)), key=str)


def test_exact_query(spark, sf, documents):
    got = sorted((tuple(r) for r in queries.op1_exact_dedup(spark, sf).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)
    assert got == expected_exact([(r.doc_id, r.text) for r in documents.collect()])


def test_exact_plan_is_native(odd):
    plan = exact_dedup.exact_dedup(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_exact_stage(odd, odd_rows, empty):
    kept = exact_dedup.drop_exact_copies(odd)
    assert kept.columns == odd.columns
    texts = [r.text or "" for r in kept.collect()]
    assert sorted(texts) == sorted(groups([r[:2] for r in odd_rows]))
    assert {r.doc_id for r in kept.filter("text = 'same text here'").collect()} == {48}
    assert exact_dedup.drop_exact_copies(empty).count() == 0 and exact_dedup.exact_dedup(empty).count() == 0


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps):
    """fps: list of (id, fp); the smallest known id of each component."""
    root = list(range(len(fps)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    values = np.array([f for _, f in fps], np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3):
            root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return [(i, f, least.get(top(k))) for k, (i, f) in enumerate(fps)]


@pytest.mark.parametrize("chunk", [simhash.CHUNK, 2])
def test_simhash_odd(odd, odd_rows, chunk):
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(odd, chunk=chunk).collect()), key=str)
    assert got == sorted(brute_components([(r[0], brute_fingerprint(r[1])) for r in odd_rows]), key=str)


def test_simhash_query(spark, sf, documents):
    rows = documents.collect()
    want = brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in rows])
    got = sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in queries.op7_simhash(spark, sf).collect())
    assert got == sorted(want)
    assert any(i != c for i, _, c in want)


def test_simhash_links_at_every_distance(spark):
    """Random fingerprints with neighbours at 1 to 5 bits, in every block of bits."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 150, np.uint64)
    more = [f ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, d, replace=False).astype(np.uint64)) for f in base for d in (1, 2, 3, 4, 5)]
    fps = sorted({int(x) for x in [*base, *more]})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    from tidemark.llm.components import components

    root = {r.node % (1 << 64): r.root for r in components(simhash.links(nodes, chunk=64)).collect()}
    want = brute_components(list(enumerate(fps)))
    by_brute, by_spark = defaultdict(set), defaultdict(set)
    for _, f, c in want:
        by_brute[c].add(f)
        by_spark[root.get(f, ("alone", f))].add(f)
    assert sorted(map(sorted, by_brute.values())) == sorted(map(sorted, by_spark.values()))


@pytest.mark.parametrize("words", [1, 4])
@pytest.mark.parametrize("n", [2, 63, 64, 65, 300])
def test_bit_sliced_distances(n, words):
    rng = np.random.default_rng(n)
    fps = rng.integers(0, 1 << 63, (n, words), np.uint64)
    fps[1::3] = fps[0] ^ (np.uint64(1) << rng.integers(0, 64, (len(fps[1::3]), words)).astype(np.uint64)) ^ np.uint64(5)
    planes = simhash.bit_planes(fps[:, 0] if words == 1 else fps)
    assert (sum(p.astype(object) << k for k, p in enumerate(np.unpackbits(c.view(np.uint8), bitorder="little")[:n] for c in simhash.carry_save(planes))) == np.bitwise_count(fps).sum(axis=1)).all()
    for shift in {1, 2, 63, 64, 65, n - 1}.intersection(range(1, n)):
        wanted = rng.random(n) < 0.7
        wanted[n - shift :] = False
        far = np.bitwise_count(fps[: n - shift] ^ fps[shift:]).sum(axis=1)
        for radius in (0, 1, 2, 3, 4, 7, 30, 100):
            want = np.flatnonzero(wanted[: n - shift] & (far <= radius))
            assert simhash.near_lanes(planes, wanted, shift, radius).tolist() == want.tolist()


def test_groups_of_all_sizes_share_the_planes():
    """Every group, pairs too, goes through the planes; the links span what comparing all pairs spans."""
    rng = np.random.default_rng(9)
    sizes = [1, 2, 2, 3, 70, 1, 5, 200]
    fps = np.concatenate([rng.integers(0, 1 << 63, 1, np.uint64) ^ (np.uint64(1) << rng.integers(0, 12, (n, 2)).astype(np.uint64)).sum(axis=1) for n in sizes])
    ends = np.cumsum(sizes)
    whole, called = simhash.near_lanes, []
    simhash.near_lanes = lambda planes, wanted, *rest: called.append(int(wanted.sum())) or whole(planes, wanted, *rest)
    try:
        found = simhash.spanning_links(fps, ends)
    finally:
        simhash.near_lanes = whole
    assert called[0] == sum(n - 1 for n in sizes)
    group = np.repeat(np.arange(len(sizes)), sizes)
    assert all(group[i] == group[j] and np.bitwise_count(fps[i] ^ fps[j]) <= 3 for i, j in found)
    for g, (a, b) in enumerate(zip(ends - sizes, ends, strict=True)):
        want = {c for _, _, c in brute_components([(int(k), int(fps[k])) for k in range(a, b)])}
        assert len([1 for i, _ in found if group[i] == g]) == (b - a) - len(want)


def test_simhash_stage(documents, odd, empty):
    kept = simhash.drop_near_copies(documents)
    assert kept.columns == documents.columns and 0 < kept.count() < documents.count()
    assert simhash.drop_near_copies(empty).count() == 0
    assert simhash.drop_near_copies(odd).filter("doc_id IS NULL").count() == 2


def brute_similar(rows, words=5, least=0.8):
    """(id, smallest id of its component) of (id, text) by the Jaccard likeness of all pairs."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or min(len(a), len(b)) >= least * max(len(a), len(b)) > 0 and len(a & b) / len(a | b) >= least:
                root[max(top(i), top(j))] = min(top(i), top(j))
    small = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            small[top(k)] = min(i, small.get(top(k), i))
    return [(i, small.get(top(k))) for k, (i, _) in enumerate(rows)]


def test_similar_is_brute_force_and_three_bits_are_not(spark, documents):
    """Edits of one word in 40, 60, 80 leave a likeness about 0.8; chains, a neighbour just below 0.8, and the given documents."""
    r = np.random.default_rng(8)
    rows = [(x.doc_id, x.text) for x in documents.collect()]
    for k in range(60):
        words = [f"w{x}" for x in r.integers(0, 500, 60 + 4 * k)]
        rows.append((100_000 + 10 * k, " ".join(words)))
        for e in range(1, 6):
            words = list(words)
            for at in r.choice(len(words), max(1, len(words) // (30 + 15 * (k % 4))), replace=False):
                words[at] = f"e{k}x{e}x{at}"
            rows.append((100_000 + 10 * k + e, "  ".join(words).upper() if e == 2 else " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = dict(brute_similar(rows))
    for chunk in (simhash.CHUNK, 2):
        got = {x.doc_id: x.component_id for x in simhash.similar(df, chunk=chunk).collect()}
        assert len(got) == len(rows) and sum(got[i] != c for i, c in want.items()) == 0
    kept = {x.doc_id for x in simhash.drop_similar(df).collect()}
    assert kept == {i for i, c in want.items() if i == c}
    by_bits = {x.doc_id for x in simhash.drop_near_copies(df).collect()}
    assert len(by_bits - kept) > 50


def test_pipeline_drops_copies_from_08(spark, documents, sf):
    import corpus_pipeline

    docs = exact_dedup.drop_exact_copies(documents)
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    kept = {x.doc_id for x in corpus_pipeline.near(spark, docs, sf).collect()}
    want = {i for i, c in brute_similar(rows) if i == c}
    assert kept == want and len(want) < len(rows)


def test_similar_odd(odd, odd_rows, empty):
    got = sorted(((x.doc_id, x.component_id) for x in simhash.similar(odd).collect()), key=str)
    assert got == sorted(brute_similar([x[:2] for x in odd_rows]), key=str)
    assert simhash.drop_similar(empty).count() == 0 and simhash.drop_similar(odd).columns == odd.columns


def long_chain(n):
    return [(i, i + 1) for i in range(n)]


def test_components_of_chains_and_stars(spark):
    from tidemark.llm.components import components

    edges = long_chain(200) + [(1000, 1000 + i) for i in range(1, 300)] + [(2001, 2000), (2002, 2001)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1300), 1000), 2000: 2000, 2001: 2000, 2002: 2000}


def brute_order_minhash(text, words=5, picked=2, bits=5):
    tokens = [t for t in re.sub(r"[ \t\n\x0b\f\r]+", " ", text or "").strip(" ").split(" ") if t]
    if not tokens:
        return []
    mask = (1 << 64) - 1

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def of_longs(values):
        seed = 42
        for v in values:
            seed = long_hash(v, seed)
        return seed

    def long_hash(v, seed):
        return xxhash.xxh64_intdigest((v & mask).to_bytes(8, "little"), seed=seed)

    hashes = [xxhash.xxh64_intdigest(t.encode(), seed=42) for t in tokens]
    kmers = [of_longs(hashes[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    seen, pairs = defaultdict(int), []
    for i, k in enumerate(kmers):
        seen[k] += 1
        n = xxhash.xxh64_intdigest(seen[k].to_bytes(4, "little"), seed=long_hash(k, 42))
        pairs.append(signed((n & ~0xFFFFFF | i & 0xFFFFFF) & mask))
    by = defaultdict(list)
    for p in sorted(pairs):
        by[p >> (64 - bits)].append(p)
    out = []
    for b in sorted(by):
        chosen = sorted((p & 0xFFFFFF, signed(p & mask & ~0xFFFFFF)) for p in by[b][:picked])
        out.append(signed((of_longs([h for _, h in chosen]) >> bits | (b << (64 - bits))) & mask))
    return out


def near(a, b, bits=5):
    bins = {x >> (64 - bits) for x in a} | {x >> (64 - bits) for x in b}
    return len(set(a) & set(b)) / len(bins) if bins else 1.0


def test_order_minhash_is_brute_force(spark, documents):
    texts = [r.text for r in documents.limit(60).collect()] + ["", " ", "a", "a b c d e", "x y " * 40, "q w e r t y " * 9]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", order_minhash.fingerprint(F.col("text")).alias("fp")).collect()
    for r in got:
        assert list(r.fp) == brute_order_minhash(texts[r.i]), texts[r.i][:80]


def expected_edited(rows):
    signed = lambda t: int.from_bytes(xxhash.xxh64_digest((t or "").encode(), seed=42), "big", signed=True)
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    out = []
    for k, (i, t) in enumerate(ordered):
        t, nxt = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = (brute_order_minhash(x) for x in (t, edited, nxt))
        hexed = lambda f: "".join(f"{x % (1 << 64):016x}" for x in f)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), near(a, b), near(a, c)))
    return out


def test_order_minhash_query(spark, sf, documents):
    want = sorted(expected_edited([(r.doc_id, r.text) for r in documents.collect()]))
    got = sorted(tuple(r) for r in queries.op8_order_minhash(spark, sf).collect())
    assert got == want
    assert sum(w[5] for w in want) > 1.5 * sum(w[6] for w in want)


def test_order_minhash_odd(spark, odd, odd_rows, empty):
    once = {r[0]: r for r in odd_rows if r[0] is not None}
    df = spark.createDataFrame(list(once.values()), odd.schema)
    got = sorted(tuple(r) for r in order_minhash.edited_fingerprints(df).collect())
    assert got == sorted(expected_edited([r[:2] for r in once.values()]))
    assert order_minhash.edited_fingerprints(odd).count() == len(odd_rows)
    assert order_minhash.edited_fingerprints(empty).count() == 0
    single = order_minhash.edited_fingerprints(df.filter("doc_id = 36")).collect()
    assert len(single) == 1 and single[0].near_next == 1.0


@pytest.mark.parametrize("ids", ["spread", "repeated", "null"])
def test_order_minhash_in_many_ranges(spark, monkeypatch, ids):
    """A few bytes a range: ids far apart, one id or null with two thirds of the rows, and the greatest and smallest ids."""
    monkeypatch.setattr(order_minhash, "RANGE_BYTES", 256)
    r = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 40, r.integers(0, 12))) + f" t{k}" for k in range(300)]
    hot = {"spread": lambda k: k * 10**15, "repeated": lambda k: 7 if k % 3 else k - 100, "null": lambda k: None if k % 3 else k}[ids]
    rows = [(hot(k), t) for k, t in enumerate(texts)] + [((1 << 63) - 1, "a b"), (-(1 << 63), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    key = lambda x: tuple((v is not None, v if v is not None else 0) for v in x)
    assert sorted(map(tuple, order_minhash.edited_fingerprints(df).collect()), key=key) == sorted(expected_edited(rows), key=key)
    n = 500
    homes = df.select(order_minhash._ranges(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), n).alias("home")).groupBy("home").count().collect()
    assert max(h["count"] for h in homes) < 12  # no hot id lies in one range
    assert len(order_minhash.edited_fingerprints(df)._jdf.queryExecution().optimizedPlan().toString()) < 400_000


def test_order_minhash_is_native_and_sees_order(spark, odd):
    assert not re.search("Python|Pandas|Arrow", order_minhash.edited_fingerprints(odd)._jdf.queryExecution().toString())
    r = np.random.default_rng(1)
    words = [f"w{i}" for i in r.permutation(2000)]
    moved = words[1000:] + words[:1000]
    a, b = brute_order_minhash(" ".join(words)), brute_order_minhash(" ".join(moved))
    assert near(a, b) < 0.8  # the same k-mers but for five, in another order
