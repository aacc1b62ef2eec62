"""Bucketed snapshot layout: no exchange below the aggregates, hot counties apart."""

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from regionpanel.operators.scores import response_blocks
from regionpanel.operators.wide import census_block, resolve_census_variables
from regionpanel.plans import requests as R
from regionpanel.plans.export import export
from regionpanel.sources.tables import Tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def bucketed(spark, small_tables):
    import tempfile
    path = tempfile.mkdtemp(prefix="rp-bucketed-") + "/snap"
    small_tables.write_snapshot(path, partitions=8, layout="bucketed")
    return Tables.load(spark, path)


def exchanges_below_fact_aggregates(df):
    """Exchanges between a scan of facts and the aggregate that is final for its county."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(re.match(r"[ :|+\-*()0-9]*", line).group())
    found = []
    for i, line in enumerate(lines):
        if "FileScan" in line and re.search("variable_id|question_id", line) and "Bucketed: true" in line:
            at, above = depth(line), []
            for up in reversed(lines[:i]):
                if depth(up) < at:
                    at = depth(up)
                    above.append(up)
                    if re.search(r"Aggregate\(keys=\[county_key[^\]]*\], functions=\[(?!partial_)", up):
                        break
            found.append(sum("Exchange" in x for x in above))
    return found


def test_same_export(small_tables, bucketed):
    for spec in (R.state_full(), R.county_full(), R.state_full(R.Scope.states("N03, N07"))):
        assert rows(export(bucketed, spec)) == rows(export(small_tables, spec))


def test_no_exchange_below_the_aggregates(bucketed):
    block = census_block(bucketed, R.ALL_STATES, resolve_census_variables(bucketed, R.ALL_VARIABLES))
    sums = response_blocks(bucketed, R.ALL_STATES, R.full_categories())[0]
    for df in (block, sums):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    found = exchanges_below_fact_aggregates(export(bucketed, R.state_full()))
    assert found == [0, 0]


def test_a_hot_county_is_split(spark, small_tables, scratch):
    hot = small_tables.responses.where("county_key = '17'").limit(1)
    many = hot.crossJoin(spark.range(20_000)).select("county_key", "question_id", (F.col("id") % 5).cast("double").alias("value"))
    tables = replace(small_tables, responses=small_tables.responses.unionByName(many), _memo={})
    tables.write_snapshot(f"{scratch}/snap", partitions=8, layout="bucketed")
    loaded = Tables.load(spark, f"{scratch}/snap")
    cold, apart = loaded.county_parts("responses")
    assert [r.county_key for r in apart.select("county_key").distinct().collect()] == ["17"]
    assert cold.where("county_key = '17'").count() == 0
    files = apart.groupBy(F.input_file_name().alias("f")).count().collect()
    assert len(files) >= 4 and max(r["count"] for r in files) < 10_000
    assert rows(export(loaded, R.state_full())) == rows(export(tables, R.state_full()))
    # replaced facts are no longer the parts
    assert len(replace(loaded, responses=tables.responses).county_parts("responses")) == 1


def test_layout_is_checked(small_tables, scratch):
    with pytest.raises(ValueError, match="layout"):
        small_tables.write_snapshot(f"{scratch}/snap", layout="rows")
