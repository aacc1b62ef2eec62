"""Snapshot by state: facts computed once, rows in county order, a hot county over several files."""

import glob
from dataclasses import replace

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from regionpanel.sources.tables import Tables


def test_facts_are_computed_once(spark, small_tables, scratch):
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    responses = small_tables.responses
    tables = replace(small_tables, responses=responses.mapInPandas(counted, responses.schema), _memo={})
    tables.write_snapshot(f"{scratch}/snap", partitions=4)
    assert seen.value == responses.count() > 0
    assert Tables.load(spark, f"{scratch}/snap").responses.count() == responses.join(small_tables.counties, "county_key").count()


@pytest.fixture()
def small_parts(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "16k")
    yield
    spark.conf.set(key, before)


def test_rows_lie_by_county_and_a_hot_county_is_split(spark, small_tables, scratch, small_parts):
    hot = "17"
    base = small_tables.responses.unionByName(
        spark.range(0, 60_000, 1, 8).select(F.lit(hot).alias("county_key"), F.xxhash64("id").alias("question_id"), F.rand(5).alias("value")))
    odd = spark.createDataFrame([(None, 1, 2.0), ("no county", 1, 2.0), (hot, None, 3.0)], "county_key string, question_id long, value double")
    responses = base.unionByName(odd)
    replace(small_tables, responses=responses, _memo={}).write_snapshot(f"{scratch}/snap", partitions=8)
    got = Tables.load(spark, f"{scratch}/snap").responses.join(small_tables.counties.select("county_key", "state_key"), ["county_key", "state_key"])
    want = responses.join(small_tables.counties.select("county_key"), "county_key")
    assert got.count() == want.count()
    assert got.select(*want.columns).exceptAll(want).count() == 0
    place = {r.county_key: i for i, r in enumerate(small_tables.counties.orderBy("state_key", "county_key").collect())}
    holds_hot = 0
    for file in glob.glob(f"{scratch}/snap/responses/state_id=*/*.parquet"):
        keys = pq.ParquetFile(file).read(["county_key"]).column(0).to_pylist()
        assert [place[k] for k in keys] == sorted(place[k] for k in keys)
        holds_hot += hot in keys
    assert holds_hot > 1
