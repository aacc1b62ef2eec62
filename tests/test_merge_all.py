"""J7 over many blocks in one shuffle."""

from functools import reduce

import pytest
from pyspark.errors import PySparkException

from regionpanel.operators.assemble import merge_all, merge_outer


def blocks(spark):
    key = "state_id string, county_id string"
    return [
        spark.createDataFrame([("1", "a", "A", 1.0), ("1", "b", "B", None), ("2", "c", "C", 3.0)], f"{key}, county_name string, x double"),
        spark.createDataFrame([("1", "b", "other", 5), ("9", "z", "Z", 6)], f"{key}, county_name string, y int"),
        spark.createDataFrame([("9", "z", 7.0, "t"), ("1", "a", 8.0, "u"), ("3", "q", None, None)], f"{key}, x double, `a.b ($)` string"),
        spark.createDataFrame([("4", "n", [1, 2])], f"{key}, many array<int>"),
    ]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_equals_successive_merges(spark, n):
    some = blocks(spark)[:n]
    got, want = merge_all(some), reduce(merge_outer, some)
    assert got.columns == want.columns and rows(got) == rows(want)


def test_one_exchange_whatever_the_number(spark):
    for n in (2, 4, 12):
        some = [spark.range(50).selectExpr("cast(id % 5 as string) state_id", "cast(id as string) county_id", f"id * {i} AS c{i}") for i in range(n)]
        plan = merge_all(some)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_null_keys_meet_and_a_repeated_key_fails(spark):
    a = spark.createDataFrame([(None, "a", 1)], "state_id string, county_id string, x int")
    b = spark.createDataFrame([(None, "a", 2)], "state_id string, county_id string, y int")
    assert rows(merge_all([a, b])) == [(None, "a", 1, 2)]
    with pytest.raises(PySparkException, match="two rows of one"):
        merge_all([a, b.union(b)]).collect()
    with pytest.raises(ValueError):
        merge_all([])


def test_empty_blocks(spark):
    a, b, *_ = blocks(spark)
    assert rows(merge_all([a.limit(0), b])) == rows(merge_outer(a.limit(0), b))
