from collections import Counter

import numpy as np
import pytest
import xxhash
from kgspark.llm import simhash
from kgspark.llm.simhash import Prints, Ring


def brute_print(text, n):
    words = simhash.WORD.findall((text or "").encode().translate(simhash.LOWER))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [b" ".join(words)]
    ones = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s, 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(rows, near):
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if near(rows[i], rows[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root(i), []).append(r)
    return groups.values()


def bits(a, b):
    return bin(a ^ b).count("1")


def test_table(odd, local):
    got = Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(odd).collect())
    rows = [(r["doc_id"], brute_print(r["text"], 4)) for r in local]
    want = Counter()
    for group in brute_components(rows, lambda a, b: bits(a[1], b[1]) <= 4):
        first = min((d for d, _ in group if d is not None), default=None)
        want.update((d, f, first) for d, f in group)
    assert got == want


def test_empty_table(none):
    assert simhash.near_duplicates(none).collect() == [] and simhash.deduplicate(none).count() == 0


def test_hex_column(spark):
    rows = simhash.op9_simhash_near_dedup(spark, "/root/testdata/sf0.001").collect()
    assert all(len(r["fingerprint"]) == 16 and r["component_id"] <= r["doc_id"] for r in rows)


def groups_of(rng, n=60):
    """Fingerprints in chains: each differs from one before in up to 6 bits."""
    out = [int(rng.integers(0, 2**63))]
    while len(out) < n:
        base = out[int(rng.integers(0, len(out)))] if rng.random() < 0.7 else int(rng.integers(0, 2**63))
        for b in rng.integers(0, 64, rng.integers(0, 7)).tolist():
            base ^= 1 << b
        out.append(base)
    return list(dict.fromkeys(out))


@pytest.mark.parametrize(("max_bits", "k", "split"), [(4, 2, 10**6), (4, 3, 10**6), (3, 1, 10**6), (6, 2, 10**6), (4, 2, 1)])
def test_links_connect_what_is_near(spark, monkeypatch, max_bits, k, split):
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    prints = groups_of(np.random.default_rng(max_bits + k))
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(p, 1, None) for p in signed], "fp long, size int, wide binary")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, max_bits, split=split, exact=k)).collect()}
    want = {}
    for group in brute_components(signed, lambda a, b: bits(a % 2**64, b % 2**64) <= max_bits):
        want |= {p: min(group) for p in group}
    assert {p: roots.get(p, p) for p in signed} == want


@pytest.mark.parametrize("pairs", [1 << 18, 300])
def test_both_bucket_searches_agree(monkeypatch, pairs):
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    rng = np.random.default_rng(2)
    p = np.array(groups_of(rng, 300), dtype=np.uint64)
    p = (p & ~np.uint64(0xFFFFF)) | np.uint64(77)  # equal in the first segments
    prints = Prints(p, np.ones(len(p), dtype=np.int64), None)
    ring = Ring(4, 2)

    def joined(i, j):
        parent = list(range(len(p)))
        for a, b in zip(i.tolist(), j.tolist()):
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            parent[max(a, b)] = min(a, b)
        out = []
        for a in range(len(p)):
            while parent[a] != a:
                a = parent[a]
            out.append(a)
        return out

    one = ring.forest(prints, ring.choices[0])
    assert len(one[0]) < len(p)
    assert joined(*one) == joined(*simhash.spanning(*ring.small(prints, np.array([0]), np.array([len(p)]), ring.choices[0])))


def test_chains_never_lose_a_pair():
    """Among the choices of equal segments one has a start whose chains are all within budget."""
    rng = np.random.default_rng(5)
    for max_bits, k in ((4, 2), (11, 2), (6, 1)):
        ring = Ring(max_bits, k)
        for _ in range(300):
            x = 0
            for b in rng.choice(64, rng.integers(0, max_bits + 1), replace=False).tolist():
                x |= 1 << b
            x = np.array([x], dtype=np.uint64)
            equal = [s for s in range(max_bits + k) if ring.segment(x, s)[0] == 0]
            assert len(equal) >= k and len(ring.chains(x, equal)) == 1


def test_stage_keeps_one_of_each_group(odd, local):
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[200] == 1 and not any(200 < i < 240 or 300 <= i < 310 for i in ids if i is not None)
    assert ids[500] == 2  # one of the repeated rows, and the other text
    assert ids[400] == 1 and 401 not in ids and 402 not in ids  # texts without words are equal
    assert ids[None] == 1  # "no id here" stays
    alone = [r["doc_id"] for r in local if r["text"] and r["doc_id"] is not None and r["doc_id"] < 120 and len(r["text"].split()) > 20]
    assert all(ids[i] == 1 for i in alone)


def lone_pairs(rng, n, size, similarity):
    """Pairs of sets of about this size and similarity."""
    for _ in range(n):
        both = round(2 * size * similarity / (1 + similarity))
        h = rng.integers(0, 2**64, 2 * size - both, dtype=np.uint64)
        yield h[:size], np.r_[h[:both], h[size:]]


@pytest.mark.parametrize("size", [40, 300])
def test_lone_pairs_of_the_limit_meet(size):
    rng = np.random.default_rng(size)
    assert all((simhash.band_keys(a) == simhash.band_keys(b)).any() for a, b in lone_pairs(rng, 1000, size, 0.82))


def test_stage_is_exact(spark):
    """Lone pairs on both sides of the limit: all of 0.8 and more are one group, none below is."""
    rng, rows, want = np.random.default_rng(8), [], set()
    for n in range(400):
        words = [f"w{x}" for x in rng.integers(0, 10**9, 64)]
        other = words[: (at := 64 - int(rng.integers(1, 16)))] + [f"v{x}" for x in rng.integers(0, 10**9, 64 - at)]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(other))]
        both = at - 4
        want |= {2 * n} if both >= 0.8 * (120 - both) else {2 * n, 2 * n + 1}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.deduplicate(docs).collect()} == want


@pytest.mark.parametrize("members", [1024, 8])
def test_stage_follows_chains(spark, monkeypatch, members):
    """A chain whose ends don't resemble each other, and strangers who share most of it, by brute force."""
    monkeypatch.setattr(simhash, "MEMBERS", members)
    rng, rows = np.random.default_rng(9), []
    base = [f"w{x}" for x in range(80)]
    for n in range(90):
        words = list(base if n % 3 else rows[int(rng.integers(0, len(rows)))][1].split() if rows else base)
        for at in rng.integers(0, 80, int(rng.integers(1, 4))).tolist():
            words[at] = f"v{n}x{at}"
        rows.append((n, " ".join(words)))
    sets = {d: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for d, t in rows}
    near = lambda a, b: len(sets[a[0]] & sets[b[0]]) >= 0.8 * len(sets[a[0]] | sets[b[0]])
    want = {min(d for d, _ in g) for g in brute_components(rows, near)}
    assert 1 < len(want) < 80
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.deduplicate(docs).collect()} == want


@pytest.mark.parametrize("members", [1024, 2])
def test_stage_searches_fingerprints(spark, monkeypatch, members):
    """The pairs that the fingerprints name connect what 4 bits connect, by brute force; equal fingerprints of different sets are pairs, too."""
    monkeypatch.setattr(simhash, "MEMBERS", members)
    rng, each = np.random.default_rng(14), []
    for n in range(40):
        base = int(rng.integers(0, 2**63))
        for m in range(int(rng.integers(1, 7))):
            flips = 0 if m == 1 else sum(1 << int(b) for b in rng.choice(63, int(rng.integers(0, 5)), replace=False))
            each.append((100 * n + m, base ^ flips, 20))
    prints = {fp: p for fp, p, _ in each}
    found = simhash.by_fingerprints(spark.createDataFrame(each, "fp long, print long, size int"), 4).collect()
    firsts = {}
    for fp, p, _ in sorted(each, reverse=True):
        firsts[p] = fp
    named = {(r["a"], firsts[r["b"]]) for r in found}
    assert all((prints[a] ^ prints[b]).bit_count() <= 4 for a, b in named)
    near = lambda a, b: (a[1] ^ b[1]).bit_count() <= 4
    linked = lambda a, b: (a[0], b[0]) in named or (b[0], a[0]) in named
    groups = lambda f: sorted(sorted(d for d, _ in g) for g in brute_components([(fp, p) for fp, p, _ in each], f))
    assert groups(linked) == groups(near) and any(len(g) > 3 for g in groups(near))
    assert members == 1024 or max(r["parts"] for r in found) > 1


def test_bucket_of_long_texts(spark, monkeypatch):
    """2,000 long texts that share most of their words, some of them near copies: blocks by shingles, and no task holds more than two."""
    monkeypatch.setattr(simhash, "ITEMS", 40_000)
    monkeypatch.setattr(simhash, "MEMBERS", 256)
    rng, rows = np.random.default_rng(12), []
    base = [f"w{x}" for x in range(400)]
    for n in range(2000):
        words = list(base)
        # a third are near copies of the base; the others have a stretch of their own that brings them to about 0.7
        if n % 3:
            words[100:180] = [f"v{n}x{x}" for x in range(80)]
        else:
            words[int(rng.integers(0, 400))] = f"v{n}"
        rows.append((n, " ".join(words)))
    kept = {r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    sets = {d: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for d, t in rows}
    a, b, c = sets[1], sets[2], sets[0]
    assert len(a & b) < 0.8 * len(a | b) and len(a & c) < 0.8 * len(a | c)
    assert kept == {0} | {n for n in range(2000) if n % 3}
