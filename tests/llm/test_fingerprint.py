import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from kgspark.llm import fingerprint as fp


def brute(text):
    """The phrase set by the plain parse, its hashes by sums."""
    seen, i = set(), 0
    while i < len(text):
        j = i + 1
        while text[i:j] in seen and j <= len(text):
            j += 1
        if j > len(text):
            break
        seen.add(text[i:j])
        i = j
    hashes = []
    for p in seen:
        total, power = 0, 1
        for c in p:
            total += (ord(c) + 1) * power
            power = power * int(fp.ODD) % 2**64
        hashes.append(total % 2**64)
    return np.unique(fp.mix(np.array(hashes, dtype=np.uint64)) >> np.uint64(32))[: fp.SIGNATURE].astype(np.uint32) if hashes else np.zeros(0, dtype=np.uint32)


def plain_likeness(a, b):
    """Common hashes among the smallest of both sets together, by sets."""
    both = sorted({*a.tolist()} | {*b.tolist()})[: fp.SIGNATURE]
    return sum(x in a and x in b for x in both) / len(both) if len(a) and len(b) else float(len(a) == len(b))


@pytest.mark.parametrize("text", ["", "a", "aaaaaaaa", "abababab", "the cat sat on the mat the cat sat", "ß€😀ß€😀", "x" * 5000])
def test_parse(text):
    assert fp.Parsed(text).signature.tolist() == brute(text).tolist()


def test_edited_goes_on_from_the_prefix():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 300))) for _ in "ab")
        text, signature = fp.Parsed(a).edited(b)
        assert text == a[: len(a) - len(a) // 4] + b[: len(a) // 4]
        assert signature.tolist() == brute(text).tolist()


def expected(rows):
    """Neighbours in order of (doc_id, text hash), nulls first; the last one's is the first."""
    def order(r):
        h = xxhash.xxh64_intdigest((r[1] or "").encode(), seed=42)
        return (r[0] is not None, r[0] or 0, h - 2**64 if h >= 2**63 else h)

    rows = sorted(rows, key=order)
    out = Counter()
    for i, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        own, other, beside = brute(text), brute(edited), brute(following)
        out[(doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{x:08x}" for x in own), "".join(f"{x:08x}" for x in other), plain_likeness(own, other), plain_likeness(own, beside))] += 1
    return out


@pytest.mark.parametrize("rows_of_a_range", [7, 1500])
def test_table(odd, local, monkeypatch, rows_of_a_range):
    monkeypatch.setattr(fp, "RANGE_ROWS", rows_of_a_range)
    assert Counter(tuple(r) for r in fp.neighbours(odd).collect()) == expected([(r["doc_id"], r["text"]) for r in local])


@pytest.mark.parametrize("rows", [[], [(1, "one")], [(None, "x")], [(None, "x"), (None, "y")], [(5, None), (5, None), (6, "")]])
def test_small_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in fp.neighbours(df).collect()) == expected(rows)


@pytest.mark.parametrize(
    "rows",
    [
        [(5, "same words")] * 30 + [(i, f"text {i}") for i in range(5)] + [(9, "behind")],
        [(5, "same words")] * 30,
        [(None, "no id")] * 20 + [(4, "b c d")] * 25 + [(3, "before"), (5, "behind")],
        [(5, "same words")] * 30 + [(6, "and here")] * 30,
    ],
)
def test_doc_ids_of_very_many_rows(spark, monkeypatch, rows):
    """Rows that are equal have the same neighbours in whatever order they are numbered."""
    monkeypatch.setattr(fp, "HOT_ROWS", 10)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(tuple(r) for r in fp.neighbours(docs).collect()) == expected(rows)


@pytest.mark.parametrize("hot_rows", [5, 1 << 40])
@pytest.mark.parametrize("seed", [1, 2])
def test_one_order_whatever_the_size_and_the_input_order(spark, monkeypatch, hot_rows, seed):
    """Different texts and repeats of doc_ids with many rows: the order is that of other doc_ids, for shuffled input too."""
    monkeypatch.setattr(fp, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(fp, "RANGE_ROWS", 4)
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice(["red", "green", "blue", "on", "off"]) for _ in range(rng.randint(0, 20)))
    rows = [(d, text()) for d in (None, 3, 7) for _ in range(31)] + [(i, text()) for i in range(12)] + [(3, "a hot row")] * 25 + [(None, None)] * 9 + [(None, "")] * 3
    want = expected(rows)
    random.Random(seed).shuffle(rows)
    got = Counter(tuple(r) for r in fp.neighbours(spark.createDataFrame(rows, "doc_id long, text string").repartition(1 + 2 * seed)).collect())
    assert got == want


def test_returned_fingerprints_can_be_compared(odd):
    rows = fp.neighbours(odd).collect()
    for r in rows[:100]:
        assert fp.likeness(fp.signature_of(r["fingerprint"]), fp.signature_of(r["edited_fingerprint"])) == r["near_edited"]


def test_likeness():
    a, b = np.array([1, 2, 3], dtype=np.uint64), np.array([2, 3, 4], dtype=np.uint64)
    none = a[:0]
    assert fp.likeness(a, b) == 0.5 and fp.likeness(a, a) == 1 and fp.likeness(none, none) == 1 and fp.likeness(a, none) == 0
