import hashlib
import random
from collections import defaultdict

import duckdb
import pytest

from kgspark.llm import lines

WHITE = " \t\n\v\f\r"


def plain(rows, least_chars=10, least_documents=2):
    """(doc_id, text) -> (doc_id, n_lines, n_dropped, kept text), by plain code."""
    cut = [(d, (t or "").split("\n")) for d, t in rows]
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(WHITE))
    found = defaultdict(set)
    for d, own in cut:
        for x in own:
            found[key(x)].add(d)
    order = lambda d: (d is None, d or 0)
    first = {k: min(ds, key=order) for k, ds in found.items() if len(k) >= least_chars and len(ds) >= least_documents}
    out = []
    for d, own in cut:
        kept = [x for x in own if first.get(key(x), d) == d]
        out.append((d, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def result(df, **options):
    got = lines.without_common_lines(df, **options).collect()
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in got), key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    common = ["A common line of some length", "  a COMMON line of some length\t", "short", "Éclair à la carte, ÀÉ", "éclair à la carte, àé", "exactly te", "exactly t", "\v\fwhite ends here\r", ""]
    rows = [(i, "\n".join(rng.choice([*common, f"own line {i} {rng.random()}"]) for _ in range(rng.randint(1, 12)))) for i in range(200)]
    rows += [(300, "\n".join(["repeated in one document"] * 5)), (301, None), (302, ""), (303, "\n\n"), (304, "x" * 200_000 + "\n" + "short"), (305, "x" * 200_000)]
    rows += [(306, "\n".join(["the hot line of them all"] + [f"line {j} of a long one" for j in range(20_000)])), (307, "\n".join(f"line {j} of a long one" for j in range(20_000)))]
    rows += [(400 + i, "the hot line of them all\nand more " + str(i % 3)) for i in range(150)]
    rows += [(None, "the hot line of them all"), (None, "only in rows without id"), (None, "only in rows without id")]
    rows += [(600, "twice the same row, the same line\nthe hot line of them all")] * 3 + [(600, "another row, of that id\ntwice the same row, the same line")]
    rows += [(-5, "negative ids come first\nthe hot line of them all"), (900, "Negative ids come first")]
    return rows


@pytest.mark.parametrize("heavy_lines", [1, 1000])
def test_against_plain_code(spark, texts, heavy_lines):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert result(df, heavy_lines=heavy_lines) == plain(texts)


def test_other_limits(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert result(df, least_chars=1, least_documents=4) == plain(texts, 1, 4)


def test_odd_documents(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    out = lines.without_common_lines(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_dropped"]
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in out.collect()), key=repr) == plain(rows)
    assert {r["doc_id"] for r in out.filter("text is null").collect()} == {r["doc_id"] for r in odd.filter("text is null").collect()}


def test_clashing_columns_are_kept(spark):
    names = ["n_lines", "n_dropped", "d1", "gone", "key", "place", "none", "rest", "own_lines", "a.b"]
    df = spark.createDataFrame([(1, "some line of text\nown", *"abcdefghij"), (2, "Some line of TEXT", *"klmnopqrst")], ["doc_id", "text", *names])
    got = {r["doc_id"]: r for r in lines.without_common_lines(df).collect()}
    assert [got[2][n] for n in names] == list("klmnopqrst") and (got[2]["n_lines_"], got[2]["n_dropped_"], got[2]["text"]) == (1, 1, "")
    assert (got[1]["n_lines_"], got[1]["n_dropped_"], got[1]["text"]) == (2, 0, "some line of text\nown")


def test_query_and_sql(spark, texts, tmp_path):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, lines.op12_line_dedup(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(((d, n, m, hashlib.sha256(t.encode()).hexdigest()) for d, n, m, t in plain(texts)), key=repr)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(db.sql(lines.SQL).fetchall(), key=repr) == got
    df.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert lines.op12_line_dedup(spark, str(tmp_path / "none")).collect() == []


def test_no_python_workers(spark, texts, tmp_path):
    df = spark.createDataFrame(texts[:5], "doc_id long, text string")
    plan = lines.without_common_lines(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
