"""A snapshot published from a loaded one: nothing is computed or joined twice, settings of the write end with it."""

from dataclasses import replace

from pyspark.sql import functions as F

import __spark_entry__ as entry
from regionpanel.functions.keys import STATE_WIDTH, pad_code
from regionpanel.sources import tables as M
from regionpanel.sources.tables import Tables


def test_both_versions_compute_the_stored_facts_once(spark, small_tables, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    responses = small_tables.responses
    tables = replace(small_tables, responses=responses.mapInPandas(counted, responses.schema), _memo={})
    monkeypatch.setattr(entry, "_tables", lambda spark, d: tables)
    monkeypatch.setattr(entry, "_KEPT", {})
    rows = entry.q_snapshot_versions(spark, "made").collect()
    assert {r.version for r in rows} == {1, 2}
    assert seen.value == responses.count() > 0


def test_a_loaded_snapshot_keeps_its_categories(spark, small_tables, scratch):
    """A repeated question gives each response once for each of its rows, however often a snapshot is rewritten."""
    twice = small_tables.questions.unionByName(small_tables.questions.limit(5))
    replace(small_tables, questions=twice, _memo={}).write_snapshot(f"{scratch}/first")
    first = Tables.load(spark, f"{scratch}/first")
    kept = replace(first, responses=first.responses.where("value > 25"), _memo={})
    kept.write_snapshot(f"{scratch}/second")
    got = Tables.load(spark, f"{scratch}/second").responses.select("county_key", "state_id", "question_id", "value", "category")
    want = kept.responses.select(*got.columns)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0


def test_replaced_questions_give_their_categories(spark, small_tables, scratch):
    small_tables.write_snapshot(f"{scratch}/first")
    first = Tables.load(spark, f"{scratch}/first")
    renamed = replace(first, questions=first.questions.withColumn("category", F.lit("new")), _memo={})
    renamed.write_snapshot(f"{scratch}/second")
    got = Tables.load(spark, f"{scratch}/second").responses
    assert got.count() == first.responses.count()
    known = got.join(first.questions.select("question_id"), "question_id", "left_semi")
    assert {r.category for r in known.select("category").distinct().collect()} == {"new"}


def test_facts_are_sorted_by_one_number(spark, small_tables):
    places = small_tables.counties.select("county_key", "state_key").withColumn("state_id", pad_code("state_key", STATE_WIDTH))
    plan = M._by_place(small_tables.responses, places, 4)._jdf.queryExecution().optimizedPlan().toString()
    sorts = [line for line in plan.splitlines() if "Sort [" in line]
    assert "Sort [_number" in sorts[0] and "state_id" not in sorts[0]


def test_settings_of_the_write_end_with_it(spark, small_tables, scratch):
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    small_tables.write_snapshot(f"{scratch}/snap")
    assert spark.conf.get(key) == before


def test_more_states_than_open_files(spark, small_tables, scratch, monkeypatch):
    monkeypatch.setattr(M, "OPEN_STATES", 2)
    small_tables.write_snapshot(f"{scratch}/snap", partitions=1)
    got = Tables.load(spark, f"{scratch}/snap").responses.select("county_key", "question_id", "value")
    want = small_tables.responses.join(small_tables.counties.select("county_key"), "county_key").select(*got.columns)
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0
