from collections import Counter

import corpus_pipeline
import pyarrow as pa
import pytest
from kgspark.llm import mixing, quality, secrets, simhash
from kgspark.llm.common import documents, stage
from kgspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = [documents(spark, SF)]
    for name, apply in corpus_pipeline.STAGES:
        docs.append(stage(apply(spark, docs[-1], SF), "step"))
    return docs


def test_columns(steps):
    for d in steps[:-1]:
        assert d.dtypes == steps[0].dtypes
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near duplicates", "secrets", "mixing", "packing"]


def test_quality_drops_what_it_rejects(spark, steps):
    model = quality.fit(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))
    rows = steps[0].collect()
    scores = model.score(pa.array([r["text"] or "" for r in rows], pa.large_string()))
    assert {r["doc_id"] for r in steps[1].collect()} == {r["doc_id"] for r, s in zip(rows, scores) if s >= 0.3}
    assert steps[1].count() < steps[0].count()


def test_one_of_each_group_stays(steps):
    rows = [(r["doc_id"], simhash.shingle_hashes((r["text"] or "").encode(), 5)) for r in steps[1].collect()]
    kept = {r["doc_id"] for r in steps[2].collect()}
    sets = {d: set(h.tolist()) for d, h in rows}
    texts = {r["doc_id"]: r["text"] for r in steps[1].collect()}
    for d in sets:
        like = [o for o in sets if o != d and len(sets[d] & sets[o]) >= 0.5 * len(sets[d] | sets[o])]
        if not like:
            assert d in kept  # nothing resembles it
    assert len({texts[d] for d in kept}) == len(kept)


def test_secrets_go_and_documents_stay(steps):
    before, after = ({r["doc_id"]: r for r in s.collect()} for s in (steps[2], steps[3]))
    assert before.keys() == after.keys()
    forest = secrets.train()
    for d, r in after.items():
        found = [x for x in secrets.scan([before[d]["text"] or ""], [before[d]["source"]], forest)[0] if x[2] >= 0.5]
        assert (r["text"] != before[d]["text"]) == bool(found)


def test_mix_takes_effect(steps):
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_documents(steps[3]).collect()}
    assert Counter(r["doc_id"] for r in steps[4].collect()) == +Counter(copies)


def test_all_copies_are_packed(steps):
    first = Counter(r["doc_id"] for r in steps[5].filter("piece = 0").collect())
    assert first == Counter(r["doc_id"] for r in steps[4].collect())


def test_run_equals_the_stages(spark, steps):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).select(columns).collect())) == Counter(map(tuple, steps[5].select(columns).collect()))


def test_odd_tables(spark, odd, none):
    for table in (odd, none):
        docs = table
        for name, apply in corpus_pipeline.STAGES:
            out = stage(apply(spark, docs, SF), "odd")
            if name != "packing":
                assert out.columns == table.columns
            docs = out
        assert docs.count() >= (10 if table is odd else 0)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("op13")))  # that one reads embeddings
def test_queries_cover_the_table(spark, name):
    out = QUERIES[name](spark, SF)
    ids = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    whole = {r["doc_id"] for r in documents(spark, SF).select("doc_id").collect()}
    assert ids <= whole if name.startswith("op4") else ids == whole
