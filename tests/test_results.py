"""Stored results answer the requests they contain."""

import pytest

from regionpanel.plans import requests as R
from regionpanel.plans.export import export
from regionpanel.plans.results import ResultStore, contains, scope_within
from regionpanel.plans.spec import CategoryChoice, ExportSpec, Scope


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def store(spark, small_tables):
    import tempfile
    s = ResultStore(spark, "file://" + tempfile.mkdtemp(prefix="rp-results-"))
    s.store(small_tables, 7, R.state_full(band="Suburban"))
    return s


DETAIL = CategoryChoice(R.DETAIL_CATEGORY, False, R.DETAIL_QUESTIONS)
NARROWER = {
    "same": R.state_full(),
    "band": R.state_full(band="Urban"),
    "states": R.state_full(Scope.states("N00, n03,N07"), band="Rural"),
    "counties": R.county_full(),
    "no states found": R.state_full(Scope.states("ZZ")),
    "one sum": ExportSpec(R.ALL_STATES, (), (), (CategoryChoice("SMALL"),), mandatory_variables=False),
    "sums, other order": ExportSpec(R.ALL_STATES, (11,), ("Top balance($)",), (CategoryChoice("SMALL"), CategoryChoice("PROMO"))),
    "census only": ExportSpec(R.ALL_STATES, (11, 15), (), (), mandatory_variables=False),
    "detail only": ExportSpec(Scope.counties("17, 00057, 3, 99999"), (), (), (DETAIL,), mandatory_variables=False),
    "never seen category": ExportSpec(R.ALL_STATES, (), (), (CategoryChoice("Registration"),), mandatory_variables=False),
}


@pytest.mark.parametrize("name", sorted(NARROWER))
def test_answers_equal_the_export(small_tables, store, name):
    spec = NARROWER[name]
    got, want = store.answer(small_tables, 7, spec), export(small_tables, spec)
    assert got is not None and got.columns == want.columns and rows(got) == rows(want)
    read = "".join(got.inputFiles())
    assert "lineitem" not in read and "orders" not in read


def test_what_is_not_contained_is_not_answered(small_tables, store):
    wider = [
        ExportSpec(R.ALL_STATES, (), (), (CategoryChoice("ECONOMY"),)),                 # a sum where questions are stored
        ExportSpec(R.ALL_STATES, (), (), (CategoryChoice(R.DETAIL_CATEGORY, False, (1, 3)),)),  # another total
        ExportSpec(R.ALL_STATES, (), (), (CategoryChoice("LARGE"),)),
        ExportSpec(R.ALL_STATES, (), R.STATE_COLUMNS, (), mandatory_variables=False),   # the state frame alone
    ]
    assert [store.answer(small_tables, 7, s) for s in wider] == [None] * 4
    assert store.answer(small_tables, 8, R.state_full()) is None
    banded = R.state_full(band="Suburban")
    assert contains(small_tables, banded, banded) and not contains(small_tables, banded, R.state_full())


def test_scopes():
    some, more = Scope.states("N1, n2"), Scope.states("n2,N1,N3")
    assert scope_within(some, more) and not scope_within(more, some) and scope_within(some, R.ALL_STATES)
    assert scope_within(Scope.counties("1, 02"), Scope.counties("001,2,3")) and not scope_within(Scope.counties("1"), some)
    assert not scope_within(R.ALL_STATES, some)


def test_a_miss_is_computed_and_stored(spark, small_tables, scratch):
    s = ResultStore(spark, f"file://{scratch}/results")
    wide = ExportSpec(Scope.states("N03, N07"), R.ALL_VARIABLES, (), (CategoryChoice("PROMO"),))
    assert rows(s.export(small_tables, 1, wide)) == rows(export(small_tables, wide)) and len(s.commits()) == 1
    narrow = ExportSpec(Scope.states("N07"), (11,), (), ())
    assert rows(s.export(small_tables, 1, narrow)) == rows(export(small_tables, narrow)) and len(s.commits()) == 1
    assert rows(s.export(small_tables, 2, narrow)) == rows(export(small_tables, narrow)) and len(s.commits()) == 2
    state = R.state_only()
    assert rows(s.export(small_tables, 1, state)) == rows(export(small_tables, state)) and len(s.commits()) == 2
