"""One county holds a third of all responses: results stay exact and the
hot key is reduced map side before any shuffle."""

import pytest
from pyspark.sql import functions as F

from regionpanel.operators import scores
from regionpanel.plans.spec import CategoryChoice, Scope
from regionpanel.sources import schema as S
from regionpanel.sources.tables import Tables


@pytest.fixture(scope="module")
def skewed(spark):
    states = spark.createDataFrame([("1", "One", "S1"), ("2", "Two", "S2")], S.STATES)
    counties = spark.createDataFrame([(str(i), "1" if i % 2 else "02", f"c{i}") for i in range(1, 301)], S.COUNTIES)
    variables = spark.createDataFrame([(1, "Overall Population"), (43, "Land Area in Square Miles")],
                                      S.CENSUS_VARIABLES)
    facts = spark.createDataFrame([(str(i), v, str(i * v)) for i in range(1, 301) for v in (1, 43)],
                                  S.CENSUS_FACTS)
    questions = spark.createDataFrame([(q, f"q{q}", "A" if q % 3 else "B") for q in range(1, 31)], S.QUESTIONS)
    # 60,000 responses; county 7 holds 20,000 of them
    base = spark.range(0, 60000).select(
        F.when(F.col("id") < 20000, F.lit("7")).otherwise(((F.col("id") % 300) + 1).cast("string")).alias("county_id"),
        ((F.col("id") % 30) + 1).alias("question_id"),
        ((F.col("id") % 5) + F.lit(0.25)).cast("string").alias("value"))
    state_wide = spark.createDataFrame([("01", 1.0), ("02", 2.0)], "state_id string, x double")
    return Tables.from_stored(states, counties, variables, facts, questions, base, state_wide), base


def test_hot_county_sums_are_exact(skewed):
    t, raw = skewed
    got = {r.county_id: r for r in scores.score_wide(t, Scope.states("S1,S2"), ["A", "B"]).collect()}
    brute = {}
    for r in raw.collect():
        cat = "A" if r.question_id % 3 else "B"
        key = r.county_id.zfill(5)
        brute.setdefault(key, {"A": 0.0, "B": 0.0})[cat] += float(r.value)
    assert set(got) == set(brute)
    for k, v in brute.items():
        assert got[k]["A_Sum"] == pytest.approx(v["A"]) and got[k]["B_Sum"] == pytest.approx(v["B"])
    assert got["00007"]["A_Sum"] + got["00007"]["B_Sum"] > 40000


def test_hot_county_is_reduced_before_the_shuffle(skewed):
    t, _ = skewed
    cats = (CategoryChoice("A"), CategoryChoice("B", False, (1, 2, 3)))
    df = scores.score_blocks(t, Scope.states("S1,S2"), cats)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # partial aggregate on county_key sits below the exchange on county_key
    assert "partial_sum" in plan and "hashpartitioning(county_key" in plan
    df.write.format("noop").mode("overwrite").save()
