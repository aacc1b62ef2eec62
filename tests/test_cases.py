"""Hand-written star schema with the traps of FIXTURES.md §4."""

import pytest
from pyspark.sql import functions as F

from regionpanel.operators import bands, headers, scores, wide
from regionpanel.operators.assemble import merge_outer
from regionpanel.operators.profile import profile
from regionpanel.plans.export import export, export_frame
from regionpanel.plans.spec import CategoryChoice, ExportSpec, Scope
from regionpanel.sources import schema as S
from regionpanel.sources.tables import Tables

AWKWARD = "a.b ($) #1"


@pytest.fixture(scope="module")
def t(spark):
    states = spark.createDataFrame([("6", "California", "CA"), ("48", "Texas", "TX"), ("2", "Alaska", "AK")],
                                   S.STATES)
    counties = spark.createDataFrame([
        ("6037", "06", "Los Angeles"), ("06001", "6", "Alameda"), ("48201", "48", "Harris"),
        ("2013", "02", "Aleutians"), ("6999", "06", "Nowhere"), ("6100", "06", "Edge150"),
        ("6200", "06", "Edge2000"), ("6300", "06", "ZeroZero"), ("6400", "06", "Score only"),
    ], S.COUNTIES)
    variables = spark.createDataFrame([(1, "Overall Population"), (43, "Land Area in Square Miles"),
                                       (5, "Median income"), (7, "Never measured")], S.CENSUS_VARIABLES)
    facts = spark.createDataFrame([
        ("6037", 1, "1000"), ("6037", 43, "5"), ("6037", 5, "50"), ("6037", 5, "51"),
        ("06001", 1, "149.99"), ("06001", 43, "1"),
        ("48201", 1, "2000.01"), ("48201", 43, "1"),
        ("2013", 1, "5"), ("2013", 43, "0"),
        ("6100", 1, "150"), ("6100", 43, "1"),
        ("6200", 1, "2000"), ("6200", 43, "1"),
        ("6300", 1, "0"), ("6300", 43, "0"),
    ], S.CENSUS_FACTS)
    questions = spark.createDataFrame([(10, "Q ten", "Reg"), (11, "Q eleven", "Reg"), (12, "Q ten", "Voting"),
                                       (13, "Q thirteen", "Registration")], S.QUESTIONS)
    responses = spark.createDataFrame([
        ("6037", 10, "1"), ("6037", 10, "2"), ("6037", 11, "3"), ("6037", 12, "4"),
        ("06001", 13, "1"), ("48201", 10, None), ("6100", 11, "1"), ("6400", 10, "5"),
    ], S.RESPONSES)
    state_wide = spark.createDataFrame([("06", 1.0, 2.0), ("48", 3.0, 4.0)], f"state_id string, `{AWKWARD}` double, Rank double")
    dictionary = spark.createDataFrame([
        (0, "Overall Population", "Census Variables"), (1, "Land Area in Square Miles", "Census Variables"),
        (2, "Reg", "Sums"), (3, AWKWARD, "State"), (4, "state_id", "identifier"), (5, "state_id", "State"),
        (6, "county_id", "identifier"),
    ], "ordinal long, name string, header string")
    return Tables.from_stored(states, counties, variables, facts, questions, responses, state_wide, dictionary)


def rows(df, key="county_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_key_forms_and_non_digits(t):
    v = wide.resolve_census_variables(t, [1])
    for code in ("06037", "6037", " 06-037 "):
        got = wide.census_wide(t, Scope.counties(code), v).collect()
        assert [(r.state_id, r.county_id, r.county_name) for r in got] == [("06", "06037", "Los Angeles")]


def test_state_scope_resolves_padded_and_unpadded(t):
    got = rows(wide.census_wide(t, Scope.states(" ca,tx "), wide.resolve_census_variables(t, [1])))
    assert set(got) == {"06037", "06001", "48201", "06100", "06200", "06300"}
    assert got["06001"]["state_id"] == "06"


def test_duplicate_fact_reported(t):
    dups = wide.pivot_duplicates(t).collect()
    assert [(r.county_key, r.variable_id, r.n_rows) for r in dups] == [("6037", 5, 2)]


def test_absent_variable_is_null_column(t):
    v = wide.resolve_census_variables(t, ["never MEASURED ", 1])
    got = rows(wide.census_wide(t, Scope.counties("6037"), v))
    assert got["06037"]["7: Never measured"] is None
    assert got["06037"]["1: Overall Population"] == 1000.0


def test_mandatory_variables_added(t):
    assert wide.resolve_census_variables(t, ["median income"], mandatory=True) == {
        1: "Overall Population", 5: "Median income", 43: "Land Area in Square Miles"}


def test_score_gaps_and_null_response(t):
    got = rows(scores.score_wide(t, Scope.states("CA,TX"), ["Reg", "Voting", "Nope"]))
    assert set(got) == {"06037", "48201", "06100", "06400"}          # 06001 has none: absent
    assert (got["06037"]["Reg_Sum"], got["06037"]["Voting_Sum"]) == (6.0, 4.0)
    assert got["48201"]["Reg_Sum"] == 0.0                             # NULL value only
    assert got["06100"]["Voting_Sum"] == 0.0 and got["06100"]["Nope_Sum"] == 0.0


def test_duplicate_ids_do_not_double(t):
    got = rows(scores.score_wide(t, Scope.counties("6037, 06037, 006037"), ["Reg"]))
    assert got["06037"]["Reg_Sum"] == 6.0


def test_dense_matrix_name_clash_and_total(t):
    labels = scores.question_labels(t, scores.question_ids(t, [12, "q ten"]))
    assert labels == {10: "Q ten", 12: "Q ten (#12)"}
    got = rows(scores.question_matrix(t, Scope.states("CA"), labels))
    assert len(got) == 7                                              # every county of CA
    assert (got["06037"]["Q ten"], got["06037"]["Q ten (#12)"], got["06037"]["selected_total"]) == (3.0, 4.0, 7.0)
    assert (got["06999"]["Q ten"], got["06999"]["selected_total"]) == (0.0, 0.0)
    long = scores.question_long_dense(t, Scope.states("CA"), labels)
    assert long.count() == 14
    assert {r.value_sum for r in long.where(F.col("county_id") == "06999").collect()} == {0.0}


def test_merge_gap_and_state_missing(t):
    spec = ExportSpec(Scope.states("CA, AK"), (1,), (AWKWARD,), (CategoryChoice("Reg"),), mandatory_variables=False)
    got = rows(export_frame(t, spec))
    assert got["06400"]["1: Overall Population"] is None and got["06400"]["county_name"] == "Score only"
    assert got["06400"]["Reg_Sum"] == 5.0
    assert got["06001"]["Reg_Sum"] is None                            # census row, not in the sum block
    assert got["02013"][AWKWARD] is None                              # state without a state row
    assert got["06037"][AWKWARD] == 1.0


def test_merge_outer_literal_keeps_left_names_only(t):
    v = wide.resolve_census_variables(t, [5])
    left = wide.census_wide(t, Scope.states("CA"), v, duplicates="largest")
    right = scores.score_wide(t, Scope.states("CA"), ["Reg"])
    got = rows(merge_outer(left, right))
    assert got["06400"]["county_name"] is None and got["06400"]["Reg_Sum"] == 5.0


@pytest.mark.parametrize("band,expected", [
    ("Rural", {"06001"}),
    ("Suburban", {"06037", "06100", "06200"}),
    ("Urban", {"48201", "02013"}),
])
def test_bands(t, band, expected):
    base = wide.census_wide(t, Scope.states("CA,TX,AK"), wide.resolve_census_variables(t, [1, 43]))
    got = set(rows(bands.filter_by_band(base, band)))
    assert got == expected


def test_band_all_keeps_zero_over_zero(t):
    base = wide.census_wide(t, Scope.states("CA,TX,AK"), wide.resolve_census_variables(t, [1, 43]))
    got = rows(bands.with_density(base, with_band=True))
    assert len(got) == 7
    assert got["06300"][bands.BAND_COLUMN] is None and got["06300"][bands.DENSITY_COLUMN] is None
    assert got["02013"][bands.BAND_COLUMN] == "Urban"


def test_headers_and_labels(t, spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, "06")],
                               "`43: Land Area in Square Miles` double, Registration_Sum double, "
                               "` 7 : x ` double, `Population Density` double, state_id string")
    df = headers.rename_columns(df)
    d = {r.column: (r.group, r.label) for r in headers.column_dictionary(df, t.header_dictionary).collect()}
    assert d["43: Land Area in Square Miles"] == ("Census Variables", "43: Land Area in Square Miles")
    assert d["Drives_Sum"] == ("Other", "Registration Drives")
    assert d["Population Density"][0] == "Other"
    assert d["state_id"][0] == "State"                                # last duplicate wins
    labelled = headers.apply_headers(df, t.header_dictionary)
    assert headers.two_row_header(labelled)[0][0] == "Census Variables"


def test_profile_edge_cases(spark):
    df = spark.createDataFrame([(5.0, None, 1.0), (None, None, float("nan"))], "one double, none double, n double")
    got = {r.column: r for r in profile(df).collect()}
    assert got["one"]["count"] == 1 and got["one"]["std"] is None and got["one"]["median"] == 5.0
    assert got["none"]["count"] == 0 and got["none"]["mean"] is None and got["none"]["median"] is None
    assert got["n"]["count"] == 1                                     # NaN skipped like pandas


def test_profile_quartiles_match_interpolation(spark):
    import numpy as np

    vals = [float(x) for x in [5, 1, 9, 9, 3, 7, 2, 2, 8, 100, -4]]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = profile(df, quartiles=True).first()
    assert r.q25 == pytest.approx(np.quantile(vals, 0.25))
    assert r.median == pytest.approx(np.quantile(vals, 0.5))
    assert r.q75 == pytest.approx(np.quantile(vals, 0.75))


def test_export_finish_drops_density_renames_and_orders(t):
    spec = ExportSpec(Scope.states("CA,TX,AK"), (), (AWKWARD,), (CategoryChoice("Registration"),), band="All")
    df = export(t, spec, labelled=True)
    assert "Drives_Sum" in df.columns and bands.DENSITY_COLUMN not in df.columns
    ids = [r.county_id for r in df.collect()]
    assert ids == sorted(ids)
    assert df.schema[AWKWARD].metadata["group"] == "State"


def test_state_only_and_empty(t):
    only = export_frame(t, ExportSpec(Scope.states("CA"), (), (AWKWARD, "Rank"), (), mandatory_variables=False))
    assert only.columns == ["state_id", AWKWARD, "Rank"] and only.count() == 1
    empty = export_frame(t, ExportSpec(Scope.states("ZZ"), (1, 43)))
    assert empty.count() == 0 and empty.columns[:4] == S.META


def test_unknown_state_column_raises(t):
    with pytest.raises(KeyError):
        wide.state_wide_select(t, None, ["nope"])


def test_read_header_dictionary_csv_keeps_last_duplicate(spark, scratch):
    path = f"{scratch}/dict.csv"
    with open(path, "w") as fh:
        fh.write('name,header,extra\n"White, non-Hispanic population",Census Variables,x\n'
                 "state_id,State Variables,y\nstate_id,identifier,z\n")
    d = headers.read_header_dictionary(spark, path)
    got = {r.key: r.header for r in headers.header_lookup(d).collect()}
    assert got == {"White, non-Hispanic population": "Census Variables", "state_id": "identifier"}
    bad = f"{scratch}/bad.csv"
    with open(bad, "w") as fh:
        fh.write("column,header\na,b\n")
    with pytest.raises(ValueError):
        headers.read_header_dictionary(spark, bad)


def test_measure_rejects_and_lenient_load(spark, t):
    facts = spark.createDataFrame([("1", 1, "12.5"), ("1", 2, "n/a"), ("2", 1, None)], S.CENSUS_FACTS)
    resp = spark.createDataFrame([("1", 10, "x"), ("1", 11, "3")], S.RESPONSES)
    got = {r.relation: r.n_rejected for r in Tables.measure_rejects(facts, resp).collect()}
    assert got == {"census_facts": 1, "responses": 1}


def test_drop_helpers_drops_land_area(t):
    from regionpanel.plans.export import finish

    spec = ExportSpec(Scope.states("CA"), (1,), ())
    df = finish(export_frame(t, spec), spec, None, drop_helpers=True)
    assert "43: Land Area in Square Miles" not in df.columns and "1: Overall Population" in df.columns
    kept = finish(export_frame(t, spec), spec, None)
    assert "43: Land Area in Square Miles" in kept.columns     # the reference's actual behaviour


def test_wide_pivot_path_equals_conditional_path(small_tables, monkeypatch):
    qids = list(range(0, 140, 2))                                # 70 questions > CONDITIONAL_LIMIT
    labels = scores.question_labels(small_tables, scores.question_ids(small_tables, qids))
    assert len(labels) > wide.CONDITIONAL_LIMIT
    scope = Scope.states("N01, N02, N03")
    a = sorted(map(tuple, scores.question_matrix(small_tables, scope, labels).collect()))
    monkeypatch.setattr(wide, "CONDITIONAL_LIMIT", 1000)
    b = sorted(map(tuple, scores.question_matrix(small_tables, scope, labels).collect()))
    assert a == b and len(a) > 0


def test_same_question_in_two_detail_blocks(t):
    cats = (CategoryChoice("Reg", False, (10, 11)), CategoryChoice("Voting", False, (10, 12)))
    got = rows(scores.score_blocks(t, Scope.states("CA"), cats))
    assert got["06037"]["Reg_Sum"] == 6.0 and got["06037"]["Voting_Sum"] == 7.0
    assert got["06037"]["Q ten"] == 3.0


def test_profile_approximate_option(spark):
    df = spark.range(0, 1001).selectExpr("CAST(id AS DOUBLE) AS x")
    exact = profile(df).first()
    approx = profile(df, exact=False).first()
    assert exact.median == 500.0 and abs(approx.median - 500.0) <= 1.0
    assert (exact["count"], exact.mean) == (approx["count"], approx.mean)


def test_colliding_names_first_block_wins(spark, t):
    """A question whose text equals a census label: the census column wins."""
    from regionpanel.operators.assemble import assemble_counties
    from regionpanel.operators.scores import Block

    v = wide.resolve_census_variables(t, [1])
    census = wide.census_block(t, Scope.states("CA"), v)
    other = census.selectExpr("county_key", "`1: Overall Population` * 0 AS `1: Overall Population`", "1.0 AS y")
    df = assemble_counties(t, Scope.states("CA"), [Block(census, ["1: Overall Population"]),
                                                   Block(other, ["1: Overall Population", "y"])])
    got = rows(df)
    assert df.columns.count("1: Overall Population") == 1 and got["06037"]["1: Overall Population"] == 1000.0


def test_pivot_raises_on_duplicates_unless_told(t):
    v = wide.resolve_census_variables(t, [1, 5])
    with pytest.raises(Exception, match="duplicate facts"):
        wide.census_wide(t, Scope.states("CA"), v).collect()
    with pytest.raises(Exception, match="duplicate facts"):
        export(t, ExportSpec(Scope.states("CA"), (1, 5))).collect()
    assert export(t, ExportSpec(Scope.states("CA"), (1, 5)), duplicates="largest").count() > 0
    assert wide.census_wide(t, Scope.states("CA"), v, duplicates="largest").count() > 0
    assert wide.census_wide(t, Scope.states("CA"), wide.resolve_census_variables(t, [1])).count() > 0


def test_pivot_ignores_duplicates_out_of_scope(t):
    v = wide.resolve_census_variables(t, [1, 5])
    assert wide.census_wide(t, Scope.counties("48201"), v).count() == 1


def _stored(spark, counties, facts=(), responses=(), questions=((1, "q", "Reg"),)):
    f = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return Tables.from_stored(
        f([("06", "California", "CA")], "state_id string, name string, abbrev string"),
        f(counties, "county_id string, state_id string, name string"),
        f([(1, "Overall Population")], "variable_id int, name string"),
        f(facts, "county_id string, variable_id int, data string"),
        f(questions, "question_id long, question string, category string"),
        f(responses, "county_id string, question_id long, value string"),
        f([("06", 1.0)], "state_id string, Rank double"))


def test_survey_values_keep_their_decimals(spark):
    t = _stored(spark, [("6037", "06", "LA")], responses=[("6037", 1, x) for x in ("0.125", "0.333", "0.004", "1e17")][:3])
    assert scores.score_wide(t, Scope.states("CA"), ["Reg"]).first()["Reg_Sum"] == pytest.approx(0.462)
    big = _stored(spark, [("6037", "06", "LA")], responses=[("6037", 1, "1e17")])
    assert scores.score_wide(big, Scope.states("CA"), ["Reg"]).first()["Reg_Sum"] == 1e17


def test_long_codes_stay_whole(spark):
    from regionpanel.operators.assemble import merge_outer

    t = _stored(spark, [("123451", "06", "A"), ("123452", "06", "B")], [("123451", 1, "1"), ("123452", 1, "2")],
                [("123451", 1, "3"), ("123452", 1, "4")])
    out = merge_outer(wide.census_wide(t, Scope.states("CA"), {1: "Overall Population"}), scores.score_wide(t, Scope.states("CA"), ["Reg"]))
    assert sorted((r.county_id, r["1: Overall Population"], r.Reg_Sum) for r in out.collect()) == [("123451", 1.0, 3.0), ("123452", 2.0, 4.0)]


def test_repeated_county_rows_on_both_sides_of_the_limit(spark):
    questions = [(i, f"q{i}", "Reg") for i in range(1, 66)]
    t = _stored(spark, [("6037", "06", "LA"), ("06037", "06", "LA")], responses=[("6037", 1, "2")], questions=questions)
    for n in (64, 65):
        labels = scores.question_labels(t, list(range(1, n + 1)))
        assert [r.q1 for r in scores.question_matrix(t, Scope.states("CA"), labels).collect()] == [2.0, 2.0]
    with pytest.raises(ValueError, match="repeated county_key"):
        t.check_keys()


def test_profile_does_not_round(spark):
    df = spark.createDataFrame([(1e-7,), (3e-7,)], "x double")
    r = profile(df).first()
    assert r.mean == pytest.approx(2e-7) and r.median == pytest.approx(2e-7) and r["std"] > 0


def test_profile_of_many_values_and_heavy_ties(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(size=30_000), np.full(20_000, 0.25), np.full(9_999, 7.0)])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    r = profile(df, quartiles=True).first()
    assert (r.q25, r.q50, r.q75) == pytest.approx(tuple(np.quantile(values, [0.25, 0.5, 0.75])))


def test_code_without_digits_names_no_county(spark):
    t = _stored(spark, [("0", "06", "Zero"), ("6037", "06", "LA")], [("0", 1, "1"), ("6037", 1, "2")])
    assert export(t, ExportSpec(Scope.counties("abc"), (1,))).collect() == []
    assert [r.county_id for r in export(t, ExportSpec(Scope.counties("abc, 00"), (1,))).collect()] == ["00000"]


def test_empty_question_list_is_a_typed_empty_frame(t):
    assert scores.question_matrix(t, Scope.states("CA"), {}).collect() == []
    assert scores.question_long_dense(t, Scope.states("CA"), {}).columns[-3:] == ["question_id", "question_name", "value_sum"]


def test_small_public_helpers(spark, t):
    from regionpanel.functions.measures import zero_fill
    from regionpanel.operators.lookups import state_variable_names
    from regionpanel.operators.profile import exact_quantiles

    df = spark.createDataFrame([(None,), (2.5,)], "x double")
    assert [r.y for r in df.select(zero_fill("x").alias("y")).collect()] == [0.0, 2.5]
    assert state_variable_names(t) == [AWKWARD, "Rank"]
    swapped = t.with_header_dictionary(spark.createDataFrame([(0, "Rank", "G")], "ordinal long, name string, header string"))
    assert swapped.header_dictionary.count() == 1 and swapped.states is t.states
    q = exact_quantiles(spark.range(1, 101).selectExpr("CAST(id AS DOUBLE) AS v"), ["v"], [0.1, 0.5, 0.9]).first()
    assert (q.q10, q.q50, q.q90) == pytest.approx((10.9, 50.5, 90.1))


def test_bad_measure_text_strict_raises_lenient_nulls(spark):
    states = spark.createDataFrame([("1", "One", "S1")], S.STATES)
    counties = spark.createDataFrame([("5", "01", "c5")], S.COUNTIES)
    variables = spark.createDataFrame([(1, "Overall Population")], S.CENSUS_VARIABLES)
    facts = spark.createDataFrame([("5", 1, "n/a")], S.CENSUS_FACTS)
    questions = spark.createDataFrame([(1, "q", "A")], S.QUESTIONS)
    responses = spark.createDataFrame([("5", 1, "2.5")], S.RESPONSES)
    sw = spark.createDataFrame([("01", 1.0)], "state_id string, x double")
    v = {1: "Overall Population"}
    strict = Tables.from_stored(states, counties, variables, facts, questions, responses, sw)
    with pytest.raises(Exception):
        wide.census_wide(strict, Scope.states("S1"), v).collect()
    lenient = Tables.from_stored(states, counties, variables, facts, questions, responses, sw, strict_measures=False)
    assert wide.census_wide(lenient, Scope.states("S1"), v).first()["1: Overall Population"] is None
