"""Known answers at sf0.01, counted independently and recorded in FIXTURES.md §2."""

import pytest
from pyspark.sql import functions as F

from regionpanel.operators import bands, scores, wide
from regionpanel.plans.export import export
from regionpanel.plans.spec import CategoryChoice, ExportSpec, Scope
from regionpanel.plans import requests as R

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def t(spark):
    from regionpanel.sources.fixture import fixture_tables

    return fixture_tables(spark, SF)


def test_counties_with_a_response_per_category(t):
    got = scores.score_long(t, R.ALL_STATES, ["PROMO", "SMALL"]).groupBy("category").count().collect()
    assert {r.category: r["count"] for r in got} == {"PROMO": 1491, "SMALL": 1491}


def test_band_counts(t):
    base = wide.census_wide(t, R.ALL_STATES, wide.resolve_census_variables(t, [1, 43]))
    got = {r[bands.BAND_COLUMN]: r["count"] for r in
           bands.with_density(base, with_band=True).groupBy(bands.BAND_COLUMN).count().collect()}
    assert got == {"Rural": 605, "Suburban": 787, "Urban": 108}


def test_raw_versus_normalised_state_join(spark, t):
    from regionpanel.sources.fixture import stored_relations

    stored = stored_relations(spark, SF)
    raw = stored["counties"].join(stored["states"], "state_id", "inner").count()
    assert raw == 932
    assert t.counties.join(t.states, "state_key", "inner").count() == 1500


def test_missing_cells_stay_null(t):
    got = wide.census_wide(t, R.ALL_STATES, wide.resolve_census_variables(t, [11]))
    assert got.count() == 1297


def test_dense_matrix_sparse_cells(t):
    labels = scores.question_labels(t, [5, 17, 300])
    assert scores.question_matrix(t, Scope.states("N03, N07"), labels).count() == 140   # wide: one row per county
    m = scores.question_long_dense(t, Scope.states("N03, N07"), labels)
    assert m.count() == 3 * 140 and m.where(F.col("value_sum") != 0).count() == 4


def test_state_scope_export_of_fixtures_md(t):
    spec = ExportSpec(Scope.states("N00, N03, N07"), (1, 43, 11), R.STATE_COLUMNS,
                      (CategoryChoice("PROMO"), CategoryChoice("SMALL"), CategoryChoice("NEVER SEEN")),
                      band="Suburban")
    assert export(t, spec).count() == 101
