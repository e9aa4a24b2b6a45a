import pytest
from kgspark.plans import runs
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def tests(spark):
    return spark.createDataFrame([(f"t{i}", i) for i in range(40)], "test_id string, n int")


def computed(part):
    """A few rows for each test, none for every fifth."""
    return part.filter("n % 5 <> 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n") % 5)))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_run_cut_in_the_middle_equals_a_whole_one(spark, tests, tmp_path):
    key = runs.run_key({"tests": tests}, {"hops": 2})
    whole = rows(runs.resume(tests, str(tmp_path / "whole"), key, computed))
    assert whole == rows(computed(tests))
    seen = []

    def fails(part):
        ids = {r["test_id"] for r in part.collect()}
        if len(seen) == 2:
            raise RuntimeError("lost")
        seen.append(ids)
        return computed(part)

    path = str(tmp_path / "cut")
    with pytest.raises(RuntimeError):
        runs.resume(tests, path, key, fails, batches=4)
    # a batch that was written but not entered doesn't count
    computed(tests).write.parquet(f"{path}/batches/stray")
    again = []

    def goes_on(part):
        again.append({r["test_id"] for r in part.collect()})
        return computed(part)

    assert rows(runs.resume(tests, path, key, goes_on, batches=4)) == whole
    assert len(again) == 2 and not set.union(*seen) & set.union(*again)
    assert rows(runs.resume(tests, path, key, lambda part: pytest.fail("all is done"), batches=3)) == whole
    more = tests.union(spark.createDataFrame([("new", 7)], tests.schema))
    assert rows(runs.resume(more, path, key, computed)) == rows(computed(more))


def test_keys_follow_contents_and_parameters(spark, tests, tmp_path):
    key = runs.run_key({"tests": tests}, {"hops": 2})
    assert runs.run_key({"tests": tests.repartition(3).orderBy(F.desc("n"))}, {"hops": 2}) == key
    changed = [({"tests": tests}, {"hops": 3}), ({"other": tests}, {"hops": 2}), ({"tests": tests.limit(39)}, {"hops": 2}), ({"tests": tests.union(tests.limit(1))}, {"hops": 2}), ({"tests": tests.withColumn("n", F.col("n").cast("long"))}, {"hops": 2}), ({"tests": tests.withColumn("n", F.when(F.col("n") != 3, F.col("n")))}, {"hops": 2})]
    assert len({runs.run_key(*c) for c in changed} | {key}) == len(changed) + 1
    assert runs.results(spark, str(tmp_path / "nothing"), key) is None
