import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from kgspark.llm import packing
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(text):
    t = Tokenizer.from_file(PATH)
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


def test_ids_are_the_librarys(local):
    bpe, library = packing.byte_bpe(PATH), Tokenizer.from_file(PATH)
    for r in local:
        text = r["text"] or ""
        assert list(bpe.encode_to_numpy(text, allowed_special="all")) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(text):
    assert list(packing.byte_bpe(PATH).encode_to_numpy(text, allowed_special="all")) == list(ids_of(text)[:-1])


def test_long_white_space(spark):
    """Runs on which tiktoken gives up."""
    texts = ["some words" + " " * 1_100_000 + "after <|endoftext|>", "\n" * 1_000_001]
    rows = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()
    for n, text in enumerate(texts):
        ids, got = ids_of(text), sorted((r for r in rows if r["doc_id"] == n), key=lambda r: r["start"])
        assert sum(r["length"] for r in got) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in got)


def check_places(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_round_trip(odd, local):
    rows = packing.pack_documents(odd, PATH).collect()
    n = check_places(rows, packing.CAPACITY)
    assert n <= -(-sum(r["length"] for r in rows) // packing.CAPACITY) + 1
    want = Counter()
    for r in local:
        ids = ids_of(r["text"])
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(r["doc_id"], piece, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want


def test_small_capacity_and_buckets(odd):
    cut = packing.stage(packing.numbered(packing.pieces(odd, PATH, 32)), "pieces")
    rows = packing.pack(cut, 32, bucket_rows=7).collect()
    assert len(rows) == cut.count()
    check_places(rows, 32)


def test_repeated_rows_are_dealt(spark, monkeypatch):
    """Also rows that are equal in all columns go to several buckets."""
    docs = spark.createDataFrame([(7, "one text")] * 300 + [(None, None)] * 300, "doc_id long, text string")
    cut = packing.stage(packing.numbered(packing.pieces(docs, PATH)), "pieces")
    sizes = []
    monkeypatch.setattr(packing.Window, "partitionBy", lambda *c, of=packing.Window.partitionBy: sizes.append(c) or of(*c))
    rows = packing.pack(cut, bucket_rows=20)
    assert sizes == [("length", "__bucket")] and len(rows.collect()) == 600
    assert check_places(rows.collect(), packing.CAPACITY) == 1
    assert cut.select("__row").distinct().count() == 600


def test_empty_table(none):
    assert packing.pack_documents(none, PATH).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 500), max_size=12))
def test_plans_hold_exactly_the_pieces(histogram):
    plan = packing.plan(histogram, 64)
    got = Counter()
    for config, n in plan.configs:
        assert n > 0 and sum(k * v for k, v in config.items()) <= 64
        for k, v in config.items():
            got[k] += v * n
    assert got == Counter(histogram)
    assert plan.bound <= plan.sequences <= plain(histogram, 64)


def plain(histogram, capacity=2048):
    """Sequences of best fit alone."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    return sum(n for _, n in packing.best_fit(lengths, np.array([histogram[int(n)] for n in lengths], dtype=np.int64), capacity))


def test_best_fit_is_best_fit():
    """The counting form against one piece after another."""
    rng = np.random.default_rng(4)
    for _ in range(20):
        sizes = sorted(rng.integers(1, 60, 200).tolist(), reverse=True)
        rooms = []
        for n in sizes:
            fit = [r for r in rooms if r >= n]
            if fit:
                rooms.remove(min(fit))
            rooms.append((min(fit) if fit else 64) - n)
        assert plain(Counter(sizes), 64) <= len(rooms) + 1


def lognormal(n):
    return Counter(np.clip(np.random.default_rng(1).lognormal(6, 0.9, n), 1, 2047).astype(int).tolist())


@pytest.mark.parametrize("pieces", [300, 10_000, 1_000_000])
def test_configurations_place_most_pieces(pieces):
    histogram = lognormal(pieces)
    plan = packing.plan(histogram)
    assert plan.placed >= 0.9 * pieces
    assert plan.sequences <= plain(histogram) and plan.sequences <= 1.001 * plan.bound + 1


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_documents_are_placed_by_configurations(spark, sf):
    """On the tables' own lengths nearly all pieces are placed by the program, in no more sequences than best fit takes."""
    cut = packing.pieces(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), PATH)
    histogram = {r["length"]: r["count"] for r in cut.filter(f"length < {packing.CAPACITY}").groupBy("length").count().collect()}
    plan = packing.plan(histogram)
    assert plan.placed > 0.9 * sum(histogram.values()) and plan.sequences <= plain(histogram) and plan.sequences <= plan.bound + 1


def test_fractions_cover_what_there_is():
    """No length is covered more often than it occurs, and the solution is at least the bound."""
    need = np.zeros(2049, dtype=np.int64)
    for n, c in lognormal(100_000).items():
        need[n] = c
    taken, bound = packing.fractional(need)
    covered = np.zeros(2049)
    for config, times in taken.items():
        assert times > 0 and sum(n * k for n, k in config) <= 2048
        for n, k in config:
            covered[n] += k * times
    assert (covered <= need + 1e-6).all() and covered.sum() > 0.3 * need.sum()
    assert any(times != int(times) for times in taken.values()) and bound <= packing.plan(lognormal(100_000)).sequences


def test_fullest_against_all_subsets():
    rng = np.random.default_rng(5)
    for _ in range(60):
        sizes = sorted(rng.integers(1, 30, 9).tolist())
        left = np.bincount(sizes, minlength=61)
        config = packing.fullest(left, sorted(set(sizes)), 60)
        assert config[sizes[-1]] >= 1 and all(left[n] >= k for n, k in config.items())
        sums = {0}
        for n in sizes[:-1]:
            sums |= {s + n for s in sums}
        assert sum(n * k for n, k in config.items()) == sizes[-1] + max(s for s in sums if s <= 60 - sizes[-1])


def test_plan_is_near_the_bound():
    histogram = Counter(np.random.default_rng(1).integers(1, 2048, 5000).tolist())
    plan = packing.plan(histogram)
    assert plan.sequences <= min(plain(histogram), 1.005 * plan.bound + 1)


def test_bound_is_right():
    """Against the least number of sequences by trying all ways, for few pieces."""
    rng = np.random.default_rng(3)

    def least(sizes, rooms):
        if not sizes:
            return len(rooms)
        n, out = sizes[0], [least(sizes[1:], [*rooms, 16 - sizes[0]])]
        for i in {r: i for i, r in enumerate(rooms) if r >= n}.values():
            out.append(least(sizes[1:], [*rooms[:i], rooms[i] - n, *rooms[i + 1 :]]))
        return min(out)

    for _ in range(15):
        sizes = sorted(rng.integers(1, 16, 7).tolist(), reverse=True)
        plan = packing.plan(Counter(sizes), 16)
        assert plan.bound <= least(sizes, []) <= plan.sequences


def test_knapsack_is_best():
    prices = np.zeros(17)
    prices[[3, 5, 7]] = 3.0, 5.5, 7.1
    best, pick = packing.knapsack(prices)
    assert abs(best[16] - max(3 * a + 5.5 * b + 7.1 * c for a in range(6) for b in range(4) for c in range(3) if 3 * a + 5 * b + 7 * c <= 16)) < 1e-9
    config = packing.configuration(pick, 16, 5)
    assert abs(sum(prices[n] * k for n, k in config.items()) - prices[5] - best[11]) < 1e-9


def test_plan_beats_best_fit_where_that_is_bad():
    """Pieces of about a third: best fit leaves gaps, configurations that fill a sequence don't."""
    histogram = Counter(np.random.default_rng(2).integers(600, 760, 20_000).tolist())
    plan = packing.plan(histogram)
    assert plan.sequences < 0.95 * plain(histogram) and plan.sequences <= 1.01 * plan.bound
