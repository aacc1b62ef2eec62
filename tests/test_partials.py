"""Incremental sums: base plus changes equal a new computation."""

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from regionpanel.operators import partials as PT
from regionpanel.operators import scores as SC
from regionpanel.plans.spec import Scope
from regionpanel.sources.versions import ConflictError

ALL = Scope.states(None)


def rows(df):
    return sorted((tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def split(small_tables):
    """(tables as they end up, base, added, withdrawn)"""
    from dataclasses import replace
    r = small_tables.responses.withColumn("h", F.pmod(F.xxhash64("county_key", "question_id"), F.lit(10)))
    base, later = r.where("h < 7").drop("h"), r.where("h >= 7").drop("h")
    withdrawn, stays = base.where("value > 30"), base.where("value <= 30 or value is null")
    return replace(small_tables, responses=stays.unionByName(later), _memo={}), base, later, withdrawn


def test_base_and_changes_equal_recomputation(spark, scratch, split):
    tables, base, later, withdrawn = split
    store = PT.PartialStore(spark, f"file://{scratch}/sums")
    store.create(base)
    store.change("new", added=later)
    store.change("gone", withdrawn=withdrawn)
    cells, cats, county = store.read(), ["PROMO", "SMALL", "Registration"], Scope.counties("17, 00057, 9")
    for scope in (ALL, county):
        assert rows(PT.score_long(tables, cells, scope, cats)) == rows(SC.score_long(tables, scope, cats))
        assert rows(PT.score_wide(tables, cells, scope, cats)) == rows(SC.score_wide(tables, scope, cats))
        labels = SC.question_labels(tables, [2, 3, 5, 7])
        assert rows(PT.question_long_dense(tables, cells, scope, labels)) == rows(SC.question_long_dense(tables, scope, labels))
    # nothing of the base facts is read
    files = "".join(PT.score_long(tables, cells, ALL, cats).inputFiles())
    assert "lineitem" not in files and "orders" not in files
    # a batch counts once; earlier states and a new base read the same
    before = store.latest().number
    assert store.change("gone", withdrawn=withdrawn) == before and rows(store.read()) == rows(cells)
    assert rows(store.read(1)) == rows(PT.partials(base))
    store.compact()
    assert rows(store.read()) == rows(cells) and len(store.latest().about["parts"]) == 1


def test_random_batches_with_infinities(spark, scratch):
    rng = random.Random(11)
    value = lambda: rng.choice([None, math.inf, -math.inf, math.nan, *map(float, range(-3, 9))])
    frame = lambda some: spark.createDataFrame(some, "county_key string, question_id long, value double")
    live = [(str(rng.randrange(6)), rng.randrange(4), value()) for _ in range(120)]
    store = PT.PartialStore(spark, f"file://{scratch}/sums")
    store.create(frame(live))
    for batch in range(3):
        gone = [live.pop(rng.randrange(len(live))) for _ in range(45)]
        new = [(str(rng.randrange(6)), rng.randrange(4), value()) for _ in range(20)]
        live += new
        store.change(f"b{batch}", frame(new), frame(gone))
    got = store.read().select(*PT.KEYS, "n", PT.cell_sum().alias("v"))
    want = frame(live).groupBy(*PT.KEYS).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    assert rows(got) == rows(want)


def test_withdrawing_what_was_never_there_fails(spark, scratch):
    frame = lambda some: spark.createDataFrame(some, "county_key string, question_id long, value double")
    store = PT.PartialStore(spark, f"file://{scratch}/sums")
    store.create(frame([("1", 1, 2.0)]))
    store.change("wrong", withdrawn=frame([("1", 2, 2.0)]))
    with pytest.raises(PySparkException, match="never added"):
        store.read().collect()


def test_two_changes_at_once_do_not_lose_one(spark, scratch, monkeypatch):
    frame = lambda some: spark.createDataFrame(some, "county_key string, question_id long, value double")
    store = PT.PartialStore(spark, f"file://{scratch}/sums")
    store.create(frame([("1", 1, 2.0)]))
    other, publish = PT.PartialStore(spark, store.root), PT.PartialStore.publish

    def slow(self, *a, **k):
        monkeypatch.setattr(PT.PartialStore, "publish", publish)
        other.change("first", added=frame([("1", 1, 3.0)]))
        return publish(self, *a, **k)

    monkeypatch.setattr(PT.PartialStore, "publish", slow)
    with pytest.raises(ConflictError):
        store.change("second", added=frame([("1", 1, 5.0)]))
    store.change("second", added=frame([("1", 1, 5.0)]))
    assert [r.total for r in store.read().collect()] == [10.0]
