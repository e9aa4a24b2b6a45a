import re
from collections import Counter, defaultdict

import pytest
from kgspark.llm import mixing
from kgspark.llm.common import stage

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def level(sizes, weights, cap=3):
    """Targets by sharing out again and again."""
    total, left, out = sum(sizes.values()), dict(weights), {}
    rest = float(total)
    while left:
        share = {s: rest * w / sum(left.values()) for s, w in left.items()}
        over = [s for s in left if share[s] > cap * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = float(cap * sizes[s])
            rest -= out[s]
            del left[s]
    return out


def test_table(odd, local):
    rows = mixing.mix_documents(odd, fan=4).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((r["doc_id"], size(r["text"])) for r in local)
    sizes = defaultdict(int)
    for r in local:
        sizes[r["source"]] += size(r["text"])
    names = [*sorted(s for s in sizes if s is not None), *[s for s in sizes if s is None]]
    want = level(sizes, {s: 1 + i % 3 for i, s in enumerate(names)})
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        s = r["source"]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6


def test_repeated_rows_are_one_item(spark, monkeypatch):
    """However often a row is repeated; its rows' copies differ by one at most, and the source's total is near its target."""
    monkeypatch.setattr(mixing, "TOGETHER", 64)
    monkeypatch.setattr(mixing, "MANY", 200)
    rows = [(1007, "the same words", "a")] * 1000 + [(None, "no id", "a")] * 500 + [(i, "w " * (i % 9), "b") for i in range(200)] + [(1008, "", "b")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert mixing.items_of(mixing.sizes(docs)).count() == 203
    out = mixing.mix_documents(docs, fan=4).collect()
    assert len(out) == len(rows) and Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    for doc in (1007, None):
        copies = {r["copies"] for r in out if r["doc_id"] == doc}
        assert max(copies) - min(copies) <= 1
    taken = Counter()
    for r in out:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[r["source"]] - r["target"]) <= 9 for r in out)
    assert Counter(r["doc_id"] for r in mixing.take(docs, fan=4).collect()) == Counter({d: n for d in {r[0] for r in rows} if (n := sum(r["copies"] for r in out if r["doc_id"] == d))})


def test_take_keeps_further_columns(spark):
    """Of equal rows that differ in a further column one stands for all."""
    docs = spark.createDataFrame([(1, "a b c", "s", f"x{i}") for i in range(5)] + [(2, "d", "s", "y")], "doc_id long, text string, source string, `__i` string")
    out = mixing.take(docs).collect()
    assert len({r["__i"] for r in out if r["doc_id"] == 1}) == 1 and len(out) == 6


def test_reruns_agree(odd):
    a, b = (sorted(map(str, mixing.mix_documents(odd.repartition(n)).collect())) for n in (2, 7))
    assert a == b


def test_chance_is_fair(spark):
    """Over seeds each document is taken as often as its share says."""
    rows = [(i, "w " * n, "ab"[i % 2], None, None) for i, n in enumerate([5, 9, 1, 30, 7, 12, 3, 20, 11, 2, 40, 8])]
    sized = stage(mixing.sizes(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")), "sizes")
    times, runs = Counter(), 16
    for seed in range(runs):
        got = mixing.mix(sized, fan=3, seed=seed).collect()
        for r in got:
            times[r["doc_id"]] += r["copies"]
        share = {r["doc_id"]: r["target"] / r["source_size"] for r in got}
    assert abs(sum(times.values()) / runs - sum(share.values())) < 1.8
    assert all(abs(times[d] / runs - f) < 0.5 for d, f in share.items())


def test_take_repeats_rows(odd, none):
    copies = Counter()
    for r in mixing.mix_documents(odd).collect():
        copies[r["doc_id"]] += r["copies"]
    out = mixing.take(odd)
    assert out.columns == odd.columns
    assert Counter(r["doc_id"] for r in out.collect()) == +copies
    assert mixing.take(none).count() == 0 and mixing.mix_documents(none).count() == 0


@pytest.mark.parametrize("texts", [[None, ""], ["a"], ["a b", None]])
def test_small_tables(spark, texts):
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    rows = mixing.mix_documents(df).collect()
    assert sum(r["taken"] for r in rows) == sum(r["size"] for r in rows)


def test_no_python_in_the_plan(odd):
    plan = mixing.mix_documents(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("task_rows", [7, 500_000])
def test_targets_of_many_sources_come_from_ranges(spark, task_rows):
    """Sources with equal ratios, without words and without a name, in ranges of a few: the targets of sharing out again and again."""
    rows = [(i, f"source {i * 37 % 101:03}", (i * i) % 50) for i in range(60)] + [(100, None, 9), (101, "none", 0), (102, "large", 4000)]
    items = spark.createDataFrame([(d, s, n, d, 1) for d, s, n in rows], "doc_id long, source string, size long, __key long, rows long")
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    names = [*sorted(s for s in sizes if s is not None), None]
    want = level(sizes, {s: 1 + i % 3 for i, s in enumerate(names)})
    got = {r["source"]: r for r in mixing.targets(items, task_rows=task_rows).collect()}
    assert got.keys() == sizes.keys()
    for s in sizes:
        assert got[s]["source_size"] == sizes[s] and got[s]["target"] == pytest.approx(want[s], abs=1e-6)
