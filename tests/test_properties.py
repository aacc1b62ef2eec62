
from functools import reduce

from pyspark.sql import functions as F

from regionpanel.functions.keys import qcol
from regionpanel.operators import bands, scores, wide
from regionpanel.plans import requests as R
from regionpanel.plans.export import export_frame
from regionpanel.plans.spec import CategoryChoice, ExportSpec, Scope


def _collect(df, key="county_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_detail_columns_add_up_to_total(small_tables):
    labels = scores.question_labels(small_tables, scores.question_ids(small_tables, R.MATRIX_QUESTIONS))
    m = scores.question_matrix(small_tables, R.ALL_STATES, labels)
    total = reduce(lambda a, b: a + b, [qcol(c) for c in labels.values()])
    assert m.where(F.abs(total - F.col("selected_total")) > 1e-6).count() == 0


def test_all_questions_of_a_category_equal_its_sum(small_tables):
    t = small_tables
    qids = [r.question_id for r in t.questions.where(F.col("category") == "PROMO").collect()]
    labels = scores.question_labels(t, qids)
    m = _collect(scores.question_matrix(t, R.ALL_STATES, labels, total_col="t"))
    s = _collect(scores.score_wide(t, R.ALL_STATES, ["PROMO"]))
    for cid, row in s.items():
        assert abs(m[cid]["t"] - row["PROMO_Sum"]) < 1e-6


def test_bands_are_disjoint_and_cover(small_tables):
    base = wide.census_wide(small_tables, R.ALL_STATES, wide.resolve_census_variables(small_tables, [1, 43]))
    parts = [set(_collect(bands.filter_by_band(base, b))) for b in ("Rural", "Suburban", "Urban")]
    everything = set(_collect(base))
    with_band = bands.with_density(base, with_band=True)
    no_band = {r.county_id for r in with_band.where(F.col(bands.BAND_COLUMN).isNull()).collect()}
    assert not (parts[0] & parts[1]) and not (parts[1] & parts[2]) and not (parts[0] & parts[2])
    assert parts[0] | parts[1] | parts[2] | no_band == everything


def test_state_export_of_all_states_equals_county_export_of_all_counties(small_tables):
    t = small_tables
    codes = ",".join(r.county_id for r in t.counties.select("county_id").collect())
    cats = (CategoryChoice("PROMO"), CategoryChoice("ECONOMY", False, (1, 3)))
    a = export_frame(t, ExportSpec(R.ALL_STATES, (1, 11, 43), R.STATE_COLUMNS, cats))
    b = export_frame(t, ExportSpec(Scope.counties(codes), (1, 11, 43), R.STATE_COLUMNS, cats))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_id_list_order_and_duplicates_do_not_matter(small_tables):
    t = small_tables
    v = wide.resolve_census_variables(t, [1])
    one = wide.census_wide(t, Scope.counties("17, 57, 3"), v).collect()
    two = wide.census_wide(t, Scope.counties("00003, 57,17, 0017, 057"), v).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))
    s1 = scores.score_wide(t, Scope.states("N01,N02"), ["PROMO"]).collect()
    s2 = scores.score_wide(t, Scope.states("n02, N01, N02"), ["PROMO"]).collect()
    assert sorted(map(tuple, s1)) == sorted(map(tuple, s2))


def test_fused_blocks_equal_separate_blocks(small_tables):
    """The one-pass score block equals the per-block operators."""
    t = small_tables
    cats = (CategoryChoice("ECONOMY", False, R.DETAIL_QUESTIONS), CategoryChoice("PROMO"), CategoryChoice("SMALL"))
    fused = _collect(scores.score_blocks(t, R.ALL_STATES, cats))
    sums = _collect(scores.score_wide(t, R.ALL_STATES, ["PROMO", "SMALL"]))
    labels = scores.question_labels(t, list(R.DETAIL_QUESTIONS))
    matrix = _collect(scores.question_matrix(t, R.ALL_STATES, labels, "ECONOMY_Sum"))
    assert set(fused) == set(matrix)
    for cid, row in fused.items():
        assert row["ECONOMY_Sum"] == matrix[cid]["ECONOMY_Sum"]
        if cid in sums:
            assert row["PROMO_Sum"] == sums[cid]["PROMO_Sum"]
        else:
            assert row["PROMO_Sum"] is None


def test_wide_fused_blocks_equal_conditional(small_tables, monkeypatch):
    """Over CONDITIONAL_LIMIT detail questions the fused block switches to
    (county, question) sums + a bounded map; results must not change."""
    from regionpanel.operators import wide as W

    t = small_tables
    cats = (CategoryChoice("ECONOMY", False, tuple(range(0, 150, 2))), CategoryChoice("PROMO"))
    a = sorted(map(tuple, scores.score_blocks(t, R.ALL_STATES, cats).collect()))
    monkeypatch.setattr(W, "CONDITIONAL_LIMIT", 1000)
    b = sorted(map(tuple, scores.score_blocks(t, R.ALL_STATES, cats).collect()))
    assert a == b and len(a) > 0


def test_results_do_not_depend_on_partitioning(spark, small_tables):
    from regionpanel.plans.export import export
    from regionpanel.operators.profile import profile

    spec = R.state_full()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("1", "7", "37"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = export(small_tables, spec)
            results.append((sorted(map(tuple, df.collect())), sorted(map(tuple, profile(df).collect()))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1] == results[2]


def test_wide_export_equals_conditional_export(small_tables, monkeypatch):
    """A full export whose detail selection is wide (cells pivoted after the
    census, sum and state joins) equals the single-aggregate path."""
    from regionpanel.operators import wide as W
    from regionpanel.plans.export import export

    cats = (CategoryChoice("ECONOMY", False, tuple(range(0, 150, 2))), CategoryChoice("PROMO"),
            CategoryChoice("Registration"))
    spec = ExportSpec(Scope.states("N01, N02, N05"), R.ALL_VARIABLES, R.STATE_COLUMNS, cats, band="Suburban")
    a = export(small_tables, spec)
    monkeypatch.setattr(W, "CONDITIONAL_LIMIT", 1000)
    b = export(small_tables, spec)
    assert a.columns == b.columns
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() > 0
