"""The request record and snapshot validation."""

import pytest

from regionpanel.plans.spec import CategoryChoice, ExportSpec, Scope


def test_spec_json_round_trip():
    spec = ExportSpec.build(Scope.counties(" 06037, 6037,48201 "), census="Overall Population, 43",
                            state=["a.b ($) #1", "Rank"],
                            categories=["Reg", ("Abuses", {"sum_scores": False, "selected_questions": ["q", 7]})],
                            band="Urban")
    assert ExportSpec.from_json(spec.to_json()) == spec
    assert spec.state_variables == ("a.b ($) #1", "Rank")
    assert spec.sum_categories() == ["Reg"] and spec.detail_categories()[0].selected_questions == ("q", 7)


def test_unknown_band_keeps_everything():
    with pytest.raises(ValueError):
        ExportSpec(band="Metro")


def test_scope_keys():
    s = Scope.counties("06037, 6037, 06-037, 0")
    assert s.county_keys() == ["", "6037"]
    assert Scope.states(" ca, CA ,tx").abbrev_keys() == ["CA", "TX"]
    assert Scope.states("*").all_states and Scope.states(None).all_states
    assert not Scope.states("").all_states and Scope.states("").abbrev_keys() == []


def test_snapshot_with_missing_column_is_rejected(spark, small_tables, scratch):
    from regionpanel.sources.tables import Tables

    small_tables.write_snapshot(f"{scratch}/snap", partitions=2)
    Tables.load(spark, f"{scratch}/snap")                       # complete: fine
    small_tables.counties.drop("county_name").write.mode("overwrite").parquet(f"{scratch}/snap/counties")
    with pytest.raises(ValueError, match="counties"):
        Tables.load(spark, f"{scratch}/snap")


def test_category_choice_defaults():
    c = CategoryChoice("Reg")
    assert c.sum_scores and c.selected_questions == ()
