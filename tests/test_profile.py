"""Exact quantiles: extreme doubles, ties, and brackets from stored sketches."""

import math
import random

import pytest
from pyspark.sql import functions as F

from regionpanel.operators import profile as P
from regionpanel.operators import sketches as S


def expected(values, p):
    v = sorted(x for x in values if x is not None and not math.isnan(x))
    if not v:
        return None
    pos = p * (len(v) - 1)
    lo, hi = v[math.floor(pos)], v[math.ceil(pos)]
    return lo if lo == hi or pos == math.floor(pos) else lo + (hi - lo) * (pos - math.floor(pos))


INF, BIG, TINY = math.inf, 1.7976931348623157e308, 5e-324
CASES = {
    "half infinite": [0.0] * 3000 + [INF] * 3000,
    "half infinite, odd": [0.0] * 3001 + [INF] * 3000,
    "both infinities": [-INF] * 2500 + [1.0] * 700 + [INF] * 2500,
    "largest doubles": [BIG] * 2600 + [-BIG] * 2400 + [TINY] * 101,
    "all infinite": [INF] * 5000,
    "neighbours": [1.0] * 2500 + [math.nextafter(1.0, 2)] * 2501 + [2.0] * 10,
    "nan and null": [float("nan"), None] * 1500 + [float(i) for i in range(3001)],
    "ties at the rank": [float(i % 3) for i in range(9000)],
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_extreme_columns_end_and_are_exact(spark, name):
    values = CASES[name]
    df = spark.createDataFrame([(x,) for x in values], "x double").repartition(3)
    got = P.exact_quantiles(df, ["x"], [0.25, 0.5, 0.75]).first()
    for p, q in ((0.25, got.q25), (0.5, got.q50), (0.75, got.q75)):
        want = expected(values, p)
        assert q == want or (math.isnan(q) and math.isnan(want))


def test_narrowing_passes_are_exact(spark, monkeypatch):
    monkeypatch.setattr(P, "GATHER", 3)
    monkeypatch.setattr(P, "ACCURACY", 20)
    rng = random.Random(5)
    columns = {"a": [rng.gauss(0, 1) for _ in range(4000)], "b": [float(rng.randrange(5)) for _ in range(4000)],
               "c": [rng.choice([INF, -INF, rng.random()]) for _ in range(4000)]}
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns))
    got = {r.column: r for r in P.exact_quantiles(df, list(columns), [0.25, 0.5, 0.75]).collect()}
    for c, v in columns.items():
        assert (got[c].q25, got[c].q50, got[c].q75) == tuple(expected(v, p) for p in (0.25, 0.5, 0.75))


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(2)
    rows = [(f"{rng.randrange(12):02d}", float(i), rng.choice([0.0, 1.0, None]), rng.expovariate(1), INF if i % 50 == 0 else float(i % 7))
            for i in range(20_000)]
    return spark.createDataFrame(rows, "state_id string, a double, b double, c double, d double")


@pytest.mark.parametrize("members", [None, ["03"], ["01", "04", "11", "99"], ["99"]])
def test_profile_from_sketches_is_the_profile(spark, panel, scratch, members):
    S.write_sketches(panel, f"{scratch}/sketches")
    sketches = spark.read.parquet(f"{scratch}/sketches")
    sub = panel if members is None else panel.where(F.col("state_id").isin(members))
    plain = lambda df: sorted(map(repr, df.collect()))
    assert plain(S.profile_from(panel, sketches, members, quartiles=True, digits=9)) == plain(P.profile(sub, quartiles=True, digits=9))


def test_one_pass_over_the_rows(spark, panel, scratch, monkeypatch):
    S.write_sketches(panel, f"{scratch}/sketches")
    passes = []
    first = P.first_pass
    monkeypatch.setattr(P, "first_pass", lambda *a: (passes.append("first"), first(*a))[1])
    monkeypatch.setattr(P, "_counted", lambda *a: pytest.fail("a second pass"))
    monkeypatch.setattr(P, "_narrowed", lambda *a: pytest.fail("a narrowing pass"))
    S.profile_from(panel, spark.read.parquet(f"{scratch}/sketches"), ["02", "05"], quartiles=True)
    assert passes == ["first"]


def test_sketches_that_miss_start_again(spark, panel, scratch, monkeypatch):
    S.write_sketches(panel, f"{scratch}/sketches")
    monkeypatch.setattr(S, "ERROR", -0.2)  # brackets beside the ranks
    got = S.profile_from(panel, spark.read.parquet(f"{scratch}/sketches"), None, quartiles=True, digits=9)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, P.profile(panel, quartiles=True, digits=9).collect()))


def test_sketches_of_another_table_are_refused(spark, panel, scratch):
    S.write_sketches(panel, f"{scratch}/sketches")
    with pytest.raises(RuntimeError, match="counts differ"):
        S.profile_from(panel.limit(100), spark.read.parquet(f"{scratch}/sketches"))
