"""Plan checks: no product, no Python UDF, pushdown / pruning on a snapshot."""

import pytest

from regionpanel.operators import scores, wide
from regionpanel.plans import requests as R
from regionpanel.plans.export import export
from regionpanel.plans.spec import CategoryChoice, ExportSpec, Scope
from regionpanel.sources.tables import Tables


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("spec_fn", [R.state_full, R.county_full])
def test_export_has_no_product_and_no_python(small_tables, spec_fn):
    p = plan_of(export(small_tables, spec_fn()))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in p


def test_dense_matrix_has_no_product(small_tables):
    labels = scores.question_labels(small_tables, list(R.MATRIX_QUESTIONS))
    p = plan_of(scores.question_long_dense(small_tables, R.ALL_STATES, labels))
    assert "CartesianProduct" not in p and "NestedLoop" not in p


def test_one_aggregate_over_responses_for_all_score_blocks(small_tables):
    cats = (CategoryChoice("ECONOMY", False, (1, 3)), CategoryChoice("PROMO"), CategoryChoice("SMALL"))
    p = plan_of(scores.score_blocks(small_tables, R.ALL_STATES, cats))
    assert p.count("lineitem.parquet") == 1


@pytest.fixture(scope="module")
def snapshot(spark, small_tables):
    import tempfile

    path = tempfile.mkdtemp(prefix="rp-snap-")
    small_tables.write_snapshot(path, partitions=4)
    return Tables.load(spark, path)


def test_snapshot_state_scope_prunes_partitions(snapshot):
    v = wide.resolve_census_variables(snapshot, [1])
    df = wide.census_wide(snapshot, Scope.states("N03"), v)
    p = plan_of(df)
    assert "PartitionFilters: [isnotnull(state_id" in p and "(state_id#" in p and "= 03)" in p


def test_snapshot_county_scope_pushes_key_filter(snapshot):
    df = scores.score_wide(snapshot, Scope.counties("00017, 57"), ["PROMO"])
    p = plan_of(df)
    assert "In(county_key, [17,57]" in p


def test_snapshot_gives_same_export(snapshot, small_tables):
    spec = ExportSpec(Scope.states("N00, N01, N03"), R.ALL_VARIABLES, R.STATE_COLUMNS, R.full_categories())
    a = sorted(map(tuple, export(snapshot, spec).collect()))
    b = sorted(map(tuple, export(small_tables, spec).collect()))
    assert a == b and len(a) > 0


def test_small_state_scope_filters_facts_before_aggregating(small_tables):
    from regionpanel.operators import dimension

    spec = ExportSpec(Scope.states("N03"), R.ALL_VARIABLES, R.STATE_COLUMNS, R.full_categories())
    p = plan_of(export(small_tables, spec))
    assert "LeftSemi" in p
    old = dimension.SCOPE_BROADCAST_ROWS
    try:
        dimension.SCOPE_BROADCAST_ROWS = 0          # too big: aggregate first, no semi join
        fresh = small_tables.__class__(**{f: getattr(small_tables, f) for f in
                                          ("states", "counties", "census_variables", "census_facts",
                                           "questions", "responses", "state_wide", "header_dictionary")})
        q = plan_of(export(fresh, spec))
        assert "LeftSemi" not in q
        a = sorted(map(tuple, export(small_tables, spec).collect()))
        b = sorted(map(tuple, export(fresh, spec).collect()))
        assert a == b and len(a) > 0
    finally:
        dimension.SCOPE_BROADCAST_ROWS = old


def test_snapshot_category_sums_need_no_dictionary_join(snapshot, small_tables):
    df = scores.score_wide(snapshot, Scope.states("N01, N03"), ["PROMO", "SMALL"])
    p = plan_of(df)
    assert "/questions" not in p and "In(category, [PROMO,SMALL])" in p
    a = sorted(map(tuple, df.collect()))
    b = sorted(map(tuple, scores.score_wide(small_tables, Scope.states("N01, N03"), ["PROMO", "SMALL"]).collect()))
    assert a == b and len(a) > 0
