"""Random export requests: the Spark export equals DuckDB SQL built for the
same request as plain SQL of the semantics (full outer merges, cross-join dense
matrices), on the sf0.001 tables."""

import functools

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import oracle_sql as O
from regionpanel.operators.profile import profile
from regionpanel.plans.export import export
from regionpanel.plans.spec import CategoryChoice, ExportSpec, Scope
from tests.conftest import SF_SMALL
from tools.check_oracle import TABLES, digest

CATEGORIES = ["STANDARD", "ECONOMY", "MEDIUM", "PROMO", "LARGE", "SMALL"]
STATE_COLS = ["Supplier count(0-n)", "Top balance($)"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@functools.cache
def question_names():
    """Question id -> text: the matrix columns' names."""
    rows = duckdb.sql(f"SELECT p_partkey, p_name || ' #' || p_partkey FROM '{SF_SMALL}/part.parquet'").fetchall()
    return dict(rows)


@st.composite
def requests(draw):
    kind = draw(st.sampled_from(["all", "state", "county"]))
    if kind == "all":
        scope, oscope = Scope.states(None), "all"
    elif kind == "state":
        ab = draw(st.lists(st.integers(0, 24), min_size=1, max_size=4, unique=True))
        text = ", ".join(f"n{a:02d}" if i % 2 else f"N{a:02d} " for i, a in enumerate(ab))
        scope, oscope = Scope.states(text), "state:" + text
    else:
        ids = draw(st.lists(st.integers(0, 149), min_size=1, max_size=6))
        codes = [str(i).zfill(draw(st.integers(1, 5))) for i in ids] + ["99999"]
        text = ", ".join(codes)
        scope, oscope = Scope.counties(text), "county:" + text
    variables = draw(st.lists(st.sampled_from([1, 11, 12, 13, 14, 15, 43]), unique=True, max_size=4))
    cats = draw(st.permutations(CATEGORIES))
    n_detail = draw(st.integers(0, 2))
    pool = draw(st.permutations(list(range(200))))
    details, start = [], 0
    for c in cats[:n_detail]:
        k = draw(st.integers(1, 5))
        details.append((c, sorted(pool[start:start + k])))
        start += k
    sums = draw(st.lists(st.sampled_from(list(cats[n_detail:]) + ["Registration"]), unique=True, max_size=3))
    state_cols = draw(st.lists(st.sampled_from(STATE_COLS), unique=True))
    band = draw(st.sampled_from(["All", "Rural", "Suburban", "Urban"]))
    choices = tuple(CategoryChoice(c, False, tuple(q)) for c, q in details) + tuple(CategoryChoice(c) for c in sums)
    spec = ExportSpec(scope, tuple(variables), tuple(state_cols), choices, band)
    sql = O.export_sql_for(oscope, variables, details, sums, state_cols, band, names=question_names())
    return spec, sql


@settings(max_examples=12, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(requests())
def test_random_export_equals_oracle(small_tables, duck, req):
    spec, sql = req
    df = export(small_tables, spec)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(sql)
    drows = cur.fetchall()
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols), spec
    assert len(rows) == len(drows), spec
    assert digest(df.columns, rows)[0] == digest(dcols, drows)[0], spec
    if rows:
        # the exact-quantile profile of the same export, against DuckDB's
        prof = profile(df, quartiles=True, digits=6)
        prows = [tuple(r) for r in prof.collect()]
        cur = duck.execute(O.profile_sql(True, sql))
        qrows = cur.fetchall()
        qcols = [d[0] for d in cur.description]
        assert digest(prof.columns, prows)[0] == digest(qcols, qrows)[0], spec


def _same(df, duck, sql):
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(sql)
    drows = cur.fetchall()
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    assert digest(df.columns, rows)[0] == digest(dcols, drows)[0]


@st.composite
def scopes(draw):
    kind = draw(st.sampled_from(["all", "state", "county"]))
    if kind == "all":
        return Scope.states(None), "all"
    if kind == "state":
        ab = draw(st.lists(st.integers(0, 30), min_size=1, max_size=4))
        text = " , ".join(f"{'n' if a % 2 else 'N'}{a:02d}" for a in ab)
        return Scope.states(text), "state:" + text
    ids = draw(st.lists(st.integers(0, 160), min_size=1, max_size=6))
    text = ", ".join(str(i).zfill(draw(st.integers(1, 6))) for i in ids)
    return Scope.counties(text), "county:" + text


@settings(max_examples=10, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(scopes(), st.lists(st.sampled_from([1, 11, 12, 13, 14, 15, 43]), min_size=1, unique=True),
       st.lists(st.sampled_from(CATEGORIES + ["Registration"]), min_size=1, max_size=3, unique=True),
       st.lists(st.integers(0, 199), min_size=1, max_size=5, unique=True))
def test_random_long_forms_equal_oracle(small_tables, duck, scope, variables, cats, qids):
    from regionpanel.operators import scores, wide

    sc, osc = scope
    t = small_tables
    _same(wide.census_long(t, sc, wide.resolve_census_variables(t, variables)), duck, O.census_long(osc, variables))
    _same(scores.score_long(t, sc, cats), duck, O.score_long(osc, cats))
    labels = scores.question_labels(t, sorted(qids))
    _same(scores.question_long_dense(t, sc, labels), duck, O.question_long_dense(osc, sorted(qids)))


@settings(max_examples=10, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="Nn0123456789 zZ", min_size=1, max_size=5), min_size=1, max_size=5),
       st.lists(st.text(alphabet="0123456789-", min_size=1, max_size=7), min_size=1, max_size=5))
def test_random_lookups_equal_oracle(small_tables, duck, abbrevs, codes):
    from regionpanel.operators import lookups

    a_text = ",".join(abbrevs)
    c_text = ",".join(codes)
    if any(x.strip() for x in abbrevs):
        _same(lookups.state_ids(small_tables, a_text), duck,
              O._with() + f"SELECT state_id FROM cs WHERE state_key IN ({O._abbrevs(a_text)})")
    if any(x.strip() for x in codes):
        _same(lookups.county_names(small_tables, c_text), duck,
              O._with() + f"SELECT county_name FROM cc WHERE county_key IN ({O._codes(c_text)})")
        _same(lookups.states_of_counties(small_tables, c_text), duck,
              O._with() + f"SELECT DISTINCT lpad(state_key, 2, '0') AS state_id FROM cc WHERE county_key IN ({O._codes(c_text)})")
