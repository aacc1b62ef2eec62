"""DuckDB oracle SQL for every registered query.

Written independently of the Spark plans as the plain SQL of the semantics
(cross join + left join for the dense matrix, full outer merges of wide
blocks, conditional sums for question columns named ``q<id>``), over the same
fixture mapping (FIXTURES.md §2) of the pre-registered TPC-H-like views.
Survey values are doubles; mean / std / quantiles are rounded to 6 places.
Every statement can be stored as a view (no PIVOT without a value list).
"""

from __future__ import annotations

from regionpanel.plans import requests as R
from regionpanel.sources import fixture as FX


def _strip(x: str) -> str:
    return f"regexp_replace(CAST({x} AS STRING), '^0+', '')"


def _pad(x: str, width: int) -> str:
    return f"lpad({x}, greatest(length({x}), {width})::INT, '0')"


def _lit_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values)


def _ident(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


_VARIABLE_VALUES = ", ".join(f"({vid}, '{name}')" for vid, name in FX.CENSUS_VARIABLE_ROWS)
_HEADER_VALUES = ", ".join(
    [f"({i}, '{name}', '{FX.HEADER_CENSUS}')" for i, (_, name) in enumerate(FX.CENSUS_VARIABLE_ROWS)]
    + [f"(100, '{FX.STATE_COUNT_COLUMN}', '{FX.HEADER_STATE}')",
       f"(101, '{FX.STATE_BALANCE_COLUMN}', '{FX.HEADER_STATE}')"]
    + [f"({200 + i}, '{m}', '{FX.HEADER_META}')" for i, m in enumerate(["state_id", "state_name", "county_id", "county_name"])]
)

# Stored relations (FIXTURES.md §2), then their canonical forms.
FIXTURE = f"""
states AS (
  SELECT CAST(n_nationkey AS STRING) AS state_id, n_name AS name,
         'N' || lpad(CAST(n_nationkey AS STRING), 2, '0') AS abbrev
  FROM nation),
counties AS (
  SELECT CAST(c_custkey AS STRING) AS county_id, lpad(CAST(c_nationkey AS STRING), 2, '0') AS state_id,
         c_name AS name
  FROM customer),
census_variables AS (SELECT * FROM (VALUES {_VARIABLE_VALUES}) v(variable_id, name)),
census_facts AS (
  SELECT CAST(o_custkey AS STRING) AS county_id, 1 AS variable_id,
         CAST(CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS STRING) AS data
  FROM orders GROUP BY o_custkey
  UNION ALL
  SELECT CAST(o_custkey AS STRING), 10 + CAST(substr(o_orderpriority, 1, 1) AS INTEGER),
         CAST(CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS STRING)
  FROM orders GROUP BY o_custkey, substr(o_orderpriority, 1, 1)
  UNION ALL
  SELECT CAST(c_custkey AS STRING), 43,
         CAST(CAST(3 * abs(CAST(c_acctbal AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS STRING)
  FROM customer),
questions AS (
  SELECT p_partkey AS question_id, p_name || ' #' || CAST(p_partkey AS STRING) AS question, p_type AS category
  FROM part),
responses AS (
  SELECT CAST(o_custkey AS STRING) AS county_id, l_partkey AS question_id, CAST(l_quantity AS STRING) AS value
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
state_wide AS (
  SELECT lpad(CAST(s_nationkey AS STRING), 2, '0') AS state_id,
         CAST(count(*) AS DOUBLE) AS "{FX.STATE_COUNT_COLUMN}", CAST(max(s_acctbal) AS DOUBLE) AS "{FX.STATE_BALANCE_COLUMN}"
  FROM supplier GROUP BY s_nationkey),
header_dictionary AS (
  SELECT * FROM (VALUES {_HEADER_VALUES}) h(ordinal, name, header)
  UNION ALL
  SELECT DISTINCT 50, category, '{FX.HEADER_SCORES}' FROM questions),
cs AS (SELECT {_strip('state_id')} AS state_key, lpad({_strip('state_id')}, 2, '0') AS state_id,
              name AS state_name, abbrev FROM states),
cc AS (SELECT {_strip('county_id')} AS county_key, {_strip('state_id')} AS state_key,
              {_pad(_strip('county_id'), 5)} AS county_id, name AS county_name FROM counties),
cf AS (SELECT {_strip('county_id')} AS county_key, variable_id, CAST(data AS DOUBLE) AS value FROM census_facts),
cr AS (SELECT {_strip('county_id')} AS county_key, question_id, CAST(value AS DOUBLE) AS value FROM responses),
csw AS (SELECT {_strip('state_id')} AS state_key, lpad({_strip('state_id')}, 2, '0') AS state_id,
               "{FX.STATE_COUNT_COLUMN}", "{FX.STATE_BALANCE_COLUMN}" FROM state_wide),
spine AS (SELECT cc.state_key, cc.county_key, cs.state_id, cs.state_name, cc.county_id, cc.county_name
          FROM cc JOIN cs ON cc.state_key = cs.state_key)
"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join([FIXTURE.strip()] + [c.strip() for c in ctes if c]) + "\n"


def _codes(text: str) -> str:
    """Typed county codes -> canonical keys (split, trim, all non-digits out, zeros stripped)."""
    items = [p.strip() for p in text.split(",") if any("0" <= c <= "9" for c in p)]
    if not items:
        return "SELECT 'no county' AS county_key"
    return (f"SELECT DISTINCT regexp_replace(regexp_replace(x, '[^0-9]', '', 'g'), '^0+', '') AS county_key "
            f"FROM (SELECT UNNEST([{_lit_list(items)}]) AS x)")


def _abbrevs(text: str) -> str:
    items = sorted({p.strip().upper() for p in text.split(",") if p.strip()})
    return f"SELECT state_key FROM cs WHERE abbrev IN ({_lit_list(items)})"


def _scope_spine(scope: str) -> str:
    """scope: 'all' | 'county:<codes>' | 'state:<abbrevs>'."""
    if scope == "all":
        return "scope_spine AS (SELECT * FROM spine)"
    kind, text = scope.split(":", 1)
    if kind == "county":
        return f"scope_spine AS (SELECT * FROM spine WHERE county_key IN ({_codes(text)}))"
    return f"scope_spine AS (SELECT * FROM spine WHERE state_key IN ({_abbrevs(text)}))"


META = "state_id, state_name, county_id, county_name"
ALL = "all"
COUNTY = "county:" + R.COUNTY_CODES


def _var_names(ids) -> dict[int, str]:
    names = dict(FX.CENSUS_VARIABLE_ROWS)
    return {i: names[i] for i in sorted(ids) if i in names}


# ----------------------------------------------------------- census blocks

def census_long(scope: str, ids) -> str:
    return _with(_scope_spine(scope)) + f"""
SELECT s.state_id, s.state_name, s.county_id, s.county_name, v.variable_id, v.name AS variable_name, f.value
FROM scope_spine s JOIN cf f ON f.county_key = s.county_key JOIN census_variables v ON v.variable_id = f.variable_id
WHERE f.variable_id IN ({_lit_list(ids)})"""


def census_wide_cte(scope: str, ids, name: str = "cw") -> str:
    cols = ", ".join(f"MAX(CASE WHEN f.variable_id = {vid} THEN f.value END) AS {_ident(f'{vid}: {n}')}"
                     for vid, n in _var_names(ids).items())
    return f"""{name} AS (
  SELECT s.state_id, s.state_name, s.county_id, s.county_name, {cols}
  FROM scope_spine s JOIN cf f ON f.county_key = s.county_key
  WHERE f.variable_id IN ({_lit_list(ids)})
  GROUP BY s.state_id, s.state_name, s.county_id, s.county_name)"""


def census_wide(scope: str, ids) -> str:
    return _with(_scope_spine(scope), census_wide_cte(scope, ids)) + "SELECT * FROM cw"


# ------------------------------------------------------------ score blocks

def score_long_cte(cats, name: str = "sl") -> str:
    return f"""{name} AS (
  SELECT s.state_id, s.state_name, s.county_id, s.county_name, q.category,
         SUM(r.value) AS score
  FROM scope_spine s JOIN cr r ON r.county_key = s.county_key JOIN questions q ON q.question_id = r.question_id
  WHERE q.category IN ({_lit_list(cats)})
  GROUP BY s.state_id, s.state_name, s.county_id, s.county_name, q.category)"""


def score_long(scope: str, cats) -> str:
    return _with(_scope_spine(scope), score_long_cte(cats)) + \
        f"SELECT {META}, category, CAST(score AS DOUBLE) AS county_category_score FROM sl"


def score_wide_cte(cats, name: str = "sw") -> str:
    cols = ", ".join(f"COALESCE(CAST(SUM(CASE WHEN category = '{c}' THEN score END) AS DOUBLE), 0.0) AS {_ident(c + '_Sum')}"
                     for c in cats)
    return score_long_cte(cats, name + "_long") + f""",
{name} AS (SELECT {META}, {cols} FROM {name}_long GROUP BY {META})"""


def score_wide(scope: str, cats) -> str:
    return _with(_scope_spine(scope), score_wide_cte(cats)) + "SELECT * FROM sw"


def dense_long_cte(qids, name: str = "dl") -> str:
    """Reference shape: selected counties x selected questions, left join responses."""
    ids = qids if isinstance(qids, str) else _lit_list(qids)       # a subquery or literal ids
    return f"""{name}_q AS (SELECT question_id, question AS question_name FROM questions WHERE question_id IN ({ids})),
{name} AS (
  SELECT s.state_id, s.state_name, s.county_id, s.county_name, q.question_id, q.question_name,
         COALESCE(SUM(r.value), 0) AS value_sum
  FROM scope_spine s CROSS JOIN {name}_q q
  LEFT JOIN cr r ON r.county_key = s.county_key AND r.question_id = q.question_id
  GROUP BY s.state_id, s.state_name, s.county_id, s.county_name, q.question_id, q.question_name)"""


def question_long_dense(scope: str, qids) -> str:
    return _with(_scope_spine(scope), dense_long_cte(qids)) + \
        f"SELECT {META}, question_id, question_name, CAST(value_sum AS DOUBLE) AS value_sum FROM dl"


def matrix_cte(qids, total: str, name: str = "qm") -> str:
    """CTEs feeding a matrix."""
    return dense_long_cte(qids, name + "_long") + f""",
{name}_src AS (SELECT {META}, question_id, CAST(value_sum AS DOUBLE) AS v FROM {name}_long),
{name}_tot AS (SELECT state_id, county_id, CAST(SUM(value_sum) AS DOUBLE) AS {_ident(total)}
               FROM {name}_long GROUP BY state_id, county_id)"""


def matrix_expr(total: str, qids, name: str = "qm", names=None) -> str:
    """Table expression of the matrix: one column per question, ``q<id>`` or its name in ``names``."""
    cols = ", ".join(f"max(CASE WHEN question_id = {q} THEN v END) AS {_ident((names or {}).get(q, f'q{q}'))}" for q in sorted(qids))
    return (f"(SELECT p.*, t.{_ident(total)} FROM (SELECT {META}, {cols} FROM {name}_src "
            f"GROUP BY {META}) p JOIN {name}_tot t USING (state_id, county_id))")


def question_matrix(scope: str, qids, total: str = "selected_total") -> str:
    return _with(_scope_spine(scope), matrix_cte(qids, total)) + f"SELECT * FROM {matrix_expr(total, qids)} m"


def _state_block(cols, scope_cte: str = "scope_spine") -> str:
    sel = ", ".join(_ident(c) for c in cols)
    return f"""stb AS (SELECT csw.state_id, {sel} FROM csw
  WHERE csw.state_key IN (SELECT state_key FROM {scope_cte}))"""


def _outer_merge(frames: list[tuple[str, str]]) -> str:
    """Reference J7 as one query: frames (alias, table expression) merged by
    successive full outer joins on (state_id, county_id); names coalesced."""
    aliases = [a for a, _ in frames]

    def first(col, among):
        return "COALESCE(" + ", ".join(f"{a}.{col}" for a in among) + ")"

    sel = [f"{first(c, aliases)} AS {c}" for c in ("state_id", "state_name", "county_id", "county_name")]
    sel += [f"{a}.* EXCLUDE (state_id, state_name, county_id, county_name)" for a in aliases]
    src = f"{frames[0][1]} {aliases[0]}"
    for i, (a, expr) in enumerate(frames[1:], 1):
        prev = aliases[:i]
        src += (f" FULL JOIN {expr} {a} ON {a}.state_id = {first('state_id', prev)}"
                f" AND {a}.county_id = {first('county_id', prev)}")
    return f"(SELECT {', '.join(sel)} FROM {src})"


def export_sql(scope: str, band: str = "All", state_only: bool = False) -> str:
    """The registered requests (``regionpanel.plans.requests``) as SQL."""
    if state_only:
        return _with(_scope_spine(scope), _state_block(list(R.STATE_COLUMNS))) + "SELECT * FROM stb"
    return export_sql_for(scope, R.ALL_VARIABLES, [(R.DETAIL_CATEGORY, list(R.DETAIL_QUESTIONS))],
                          list(R.SUM_CATEGORIES), list(R.STATE_COLUMNS), band)


def export_sql_for(scope: str, variables, details, sums, state_cols, band: str = "All",
                   mandatory: bool = True, names=None) -> str:
    """Export SQL for any request: census ids, detail blocks [(category,
    question ids)], summed categories, state columns, band (the reference's
    full outer merges; state columns by state id; band filter; rename)."""
    ids = sorted(set(variables) | ({1, 43} if mandatory else set()))
    ctes, frames = [_scope_spine(scope)], []
    if ids:
        ctes.append(census_wide_cte(scope, ids, "cw"))
        frames.append(("cw", "cw"))
    for j, (cat, qids) in enumerate(details):
        ctes.append(matrix_cte(list(qids), cat + "_Sum", f"em{j}"))
        frames.append((f"em{j}", matrix_expr(cat + "_Sum", list(qids), f"em{j}", names)))
    if sums:
        ctes.append(score_wide_cte(list(sums), "sw"))
        frames.append(("sw", "sw"))
    ctes.append(_state_block(list(state_cols)) if state_cols else "")
    merged = _outer_merge(frames)
    state_sel = "".join(", stb." + _ident(c) for c in state_cols)
    state_join = "LEFT JOIN stb ON mg.state_id = stb.state_id" if state_cols else ""
    cats = set(sums) | {c for c, _ in details}
    rename = " RENAME (Registration_Sum AS Drives_Sum)" if "Registration" in cats else ""
    pop, area = _ident("1: Overall Population"), _ident("43: Land Area in Square Miles")
    where = "" if band == "All" else f"WHERE {_band_expr(pop, area)} = '{band}'"
    return _with(*ctes) + f"""SELECT *{rename} FROM (
  SELECT mg.*{state_sel} FROM {merged} mg {state_join}) fin {where}"""


def _band_expr(pop: str, area: str) -> str:
    p, a = f"CAST({pop} AS DOUBLE)", f"CAST({area} AS DOUBLE)"
    return f"""(CASE WHEN {p} IS NULL OR {a} IS NULL THEN NULL
      WHEN {a} = 0 AND {p} > 0 THEN 'Urban'
      WHEN {a} = 0 AND {p} < 0 THEN 'Rural'
      WHEN {a} = 0 THEN NULL
      WHEN {p} / {a} < 150 THEN 'Rural'
      WHEN {p} / {a} <= 2000 THEN 'Suburban'
      ELSE 'Urban' END)"""


def _density_sql(band: str | None, with_band: bool = False) -> str:
    pop, area = _ident("1: Overall Population"), _ident("43: Land Area in Square Miles")
    dens = f"CASE WHEN CAST({area} AS DOUBLE) = 0 THEN NULL ELSE CAST({pop} AS DOUBLE) / CAST({area} AS DOUBLE) END"
    extra = f", {_band_expr(pop, area)} AS density_band" if with_band else ""
    where = f"WHERE {_band_expr(pop, area)} = '{band}'" if band else ""
    return _with(_scope_spine(ALL), census_wide_cte(ALL, R.DENSITY_VARIABLES)) + \
        f'SELECT *, {dens} AS "Population Density"{extra} FROM cw {where}'


# ---------------------------------------------------------------- profile

def profile_sql(quartiles: bool, base: str | None = None) -> str:
    base = base or export_sql(ALL)
    stats = ["count(v)::BIGINT AS count", "round(avg(v), 6) AS mean", "round(stddev_samp(v), 6) AS std",
             "min(v) AS min"]
    if quartiles:
        stats += ["round(quantile_cont(v, 0.25), 6) AS q25", "round(quantile_cont(v, 0.5), 6) AS q50",
                  "round(quantile_cont(v, 0.5), 6) AS median", "round(quantile_cont(v, 0.75), 6) AS q75"]
    else:
        stats += ["round(quantile_cont(v, 0.5), 6) AS median"]
    stats += ["max(v) AS max"]
    return f"""SELECT "column", {", ".join(stats)}
FROM ({base}) ex UNPIVOT INCLUDE NULLS
      (v FOR "column" IN (COLUMNS(* EXCLUDE (state_id, state_name, county_id, county_name))))
GROUP BY "column"
"""


#: fixed values: the labels of the score sums
_SUM_LABEL_VALUES = """('Reg_Sum', 'Provison of Information About Registration (Overall Score)'),
  ('Voting_Sum', 'Provision of Information About Voting (Overall Score)'),
  ('Abuses_Sum', 'History of Voting Rights Abuses in County'),
  ('pollworkers_Sum', 'Availability of Poll Workers (Overall Score)'),
  ('Drives_Sum', 'Registration Drives'), ('dropboxes_Sum', 'Drop Box Availability'),
  ('Vote Centers_Sum', 'Vote Center Availability'),
  ('Ease of Registration_Sum', 'Ease of Registration (Overall Score)')"""


def header_apply_sql() -> str:
    base = export_sql(ALL)
    return _with(f"""hl AS (SELECT {_LABEL.replace('label', 'name')} AS key, arg_max(header, ordinal) AS header
  FROM header_dictionary GROUP BY ALL)""", f"""d AS (SELECT column_name AS "column", row_number() OVER () - 1 AS pos FROM (DESCRIBE {base}))""",
        """cols AS (SELECT "column", CAST(pos AS INTEGER) AS ordinal FROM d)""",
        f"lbl AS (SELECT * FROM (VALUES {_SUM_LABEL_VALUES}) t(\"column\", friendly))") + f"""
SELECT c.ordinal, c."column", COALESCE(hl.header, 'Other') AS "group", COALESCE(lbl.friendly, c."column") AS label
FROM cols c LEFT JOIN hl ON hl.key = {_LABEL.replace('label', 'c."column"')} LEFT JOIN lbl ON lbl."column" = c."column"
"""


# ------------------------------------------------------------------ table

def _row_counts() -> str:
    rels = ["states", "counties", "census_variables", "census_facts", "questions", "responses", "state_wide"]
    return _with() + " UNION ALL ".join(f"SELECT '{r}' AS relation, count(*) AS n_rows FROM {r}" for r in rels)


_SPLIT = _with() + """
SELECT trim(code) AS code, regexp_replace(regexp_replace(trim(code), '[^0-9]', '', 'g'), '^0+', '') AS county_key
FROM (SELECT UNNEST(string_split(' ' || county_id || ' ,' || lpad(county_id, 5, '0') || ',, ', ',')) AS code FROM counties)
WHERE trim(code) <> ''"""

_LABEL = r"trim(regexp_replace(regexp_replace(trim(label), '^\d+\s*:\s*', ''), '_Sum$', ''))"

ORACLE: dict[str, str] = {
    "snapshot_row_counts": _row_counts(),
    "column_scan": _with() + "SELECT category FROM questions",
    "question_catalogue": _with() + "SELECT question, category FROM questions",
    "variable_names": _with() + """SELECT v.name AS name FROM census_facts f
JOIN census_variables v ON v.variable_id = f.variable_id""",
    "mandatory_variables": _with() + """SELECT variable_id, name AS variable_name FROM census_variables
WHERE lower(trim(name)) IN (SELECT lower(trim(category)) FROM questions
                            UNION ALL SELECT 'land area in square miles' UNION ALL SELECT 'overall population')""",
    "state_variable_list": _with() + f"""SELECT '{FX.STATE_COUNT_COLUMN}' AS variable, count(*) AS n_states FROM csw
UNION ALL SELECT '{FX.STATE_BALANCE_COLUMN}', count(*) FROM csw""",
    "split_trim_codes": _SPLIT,
    "code_normalise": _with() + f"""SELECT county_id AS county_id_stored, state_id AS state_id_stored,
  {_strip('county_id')} AS county_key, {_strip('state_id')} AS state_key,
  lpad({_strip('county_id')}, 5, '0') AS county_id, lpad({_strip('state_id')}, 2, '0') AS state_id FROM counties""",
    "code_digits_only": _with() + """SELECT name, regexp_replace(name, '[^0-9]', '', 'g') AS digits,
  regexp_replace(regexp_replace(name, '[^0-9]', '', 'g'), '^0+', '') AS county_key,
  lpad(regexp_replace(regexp_replace(name, '[^0-9]', '', 'g'), '^0+', ''), 5, '0') AS county_id FROM counties""",
    "label_normalise": _with() + f"""SELECT label, {_LABEL} AS normalised FROM (
  SELECT CAST(question_id AS STRING) || ': ' || question AS label FROM questions
  UNION ALL SELECT category || '_Sum' FROM questions
  UNION ALL SELECT ' ' || CAST(question_id AS STRING) || ' : ' || question || ' ' FROM questions)""",
    "state_lookup": _with() + f"SELECT state_id FROM cs WHERE state_key IN ({_abbrevs(R.STATE_ABBREVS)})",
    "states_of_counties": _with() + f"""SELECT DISTINCT lpad(state_key, 2, '0') AS state_id FROM cc
WHERE county_key IN ({_codes(R.COUNTY_CODES)})""",
    "county_names": _with() + f"SELECT county_name FROM cc WHERE county_key IN ({_codes(R.COUNTY_CODES)})",
    "question_lookup": _with() + f"""SELECT question_id, question FROM questions
WHERE lower(trim(question)) IN (SELECT lower(trim(upper('  ' || question || ' '))) FROM questions
                                WHERE category = '{R.DETAIL_CATEGORY}')""",
    "census_variable_lookup": _with() + """SELECT variable_id, name AS variable_name FROM census_variables
WHERE lower(trim(name)) IN (SELECT lower(trim(name)) FROM header_dictionary)""",
    "catalogue_search": _with() + f"SELECT * FROM questions WHERE contains(lower(question), '{R.SEARCH_TEXT}')",
    "question_categories": _with() + "SELECT category, min(question_id) AS first_question_id FROM questions GROUP BY category",
    "questions_in_category": _with() + f"SELECT question_id, question FROM questions WHERE category = '{R.DETAIL_CATEGORY}'",
    "state_wide_select": _with() + f"SELECT state_id, {', '.join(_ident(c) for c in reversed(R.STATE_COLUMNS))} FROM csw",
    "county_dimension": _with() + f"SELECT {META} FROM spine",
    "merge_outer": _with(_scope_spine(ALL), census_wide_cte(ALL, [11]), score_wide_cte(["PROMO"])) + """
SELECT * FROM cw FULL JOIN (SELECT * EXCLUDE (state_name, county_name) FROM sw) r USING (state_id, county_id)""",
    "attach_state_vars": _with(_scope_spine(ALL), census_wide_cte(ALL, R.DENSITY_VARIABLES),
                               _state_block(list(R.STATE_COLUMNS))) + """
SELECT cw.*, stb.* EXCLUDE (state_id) FROM cw LEFT JOIN stb ON cw.state_id = stb.state_id""",
    "dup_ids_score": score_wide("county:" + R.DUP_COUNTY_CODES, ["PROMO", "SMALL"]),
    "census_long_state": census_long(ALL, R.ALL_VARIABLES),
    "census_long_county": census_long(COUNTY, R.ALL_VARIABLES),
    "census_wide_state": census_wide(ALL, R.BASIC_VARIABLES),
    "census_wide_county": census_wide(COUNTY, R.ALL_VARIABLES),
    "pivot_duplicate_check": _with() + """SELECT county_key, question_id, count(*) AS n_rows FROM cr
GROUP BY county_key, question_id HAVING count(*) > 1""",
    "empty_selection": census_wide("state:" + R.UNKNOWN_STATES, R.DENSITY_VARIABLES),
    "score_long_state": score_long(ALL, R.SUM_CATEGORIES),
    "score_long_county": score_long(COUNTY, R.SUM_CATEGORIES),
    "score_wide_state": score_wide(ALL, R.SUM_CATEGORIES),
    "score_wide_county": score_wide(COUNTY, R.SUM_CATEGORIES),
    "question_long_dense": question_long_dense(ALL, R.MATRIX_QUESTIONS),
    "question_long_dense_county": question_long_dense(COUNTY, R.MATRIX_QUESTIONS),
    "question_matrix_state": question_matrix(ALL, R.MATRIX_QUESTIONS),
    "question_matrix_county": question_matrix(COUNTY, R.MATRIX_QUESTIONS),
    "score_blocks_state": _with(_scope_spine(ALL), matrix_cte(R.DETAIL_QUESTIONS, R.DETAIL_CATEGORY + "_Sum", "em"),
                                score_wide_cte(R.SUM_CATEGORIES, "sw")) +
    "SELECT * FROM " + _outer_merge([("em", matrix_expr(R.DETAIL_CATEGORY + "_Sum", R.DETAIL_QUESTIONS, "em")), ("sw", "sw")]) + " mg",
    "question_matrix_category": _with(_scope_spine(ALL)) + f"""SELECT {META}, q.question_id, q.question AS question_name, SUM(r.value) AS value_sum
FROM scope_spine s JOIN cr r ON r.county_key = s.county_key JOIN questions q ON q.question_id = r.question_id
WHERE q.category = '{R.DETAIL_CATEGORY}' GROUP BY ALL""",
    "question_matrix_64": question_matrix(ALL, range(1, 65)),
    "question_matrix_65": question_matrix(ALL, range(1, 66)),
    "question_matrix_names": _with(_scope_spine(ALL), dense_long_cte(R.MATRIX_QUESTIONS)) + """SELECT county_id, question_name AS "column", value_sum AS value FROM dl
UNION ALL SELECT county_id, 'selected_total', SUM(value_sum) FROM dl GROUP BY county_id""",
    "empty_question_matrix": _with(_scope_spine(ALL)) + f"SELECT {META}, 0.0::DOUBLE AS selected_total FROM scope_spine WHERE false",
    "score_fraction": _with(_scope_spine(ALL), """fr AS (SELECT ltrim(CAST(o_custkey AS STRING), '0') AS county_key, l_partkey AS question_id,
  CAST(l_extendedprice AS DOUBLE) * CAST(l_discount AS DOUBLE) / 997 AS value FROM orders JOIN lineitem ON o_orderkey = l_orderkey)""") + f"""
SELECT {META}, round(COALESCE(SUM(CASE WHEN category = 'PROMO' THEN value END), 0), 6) AS "PROMO_Sum",
  round(COALESCE(SUM(CASE WHEN category = 'SMALL' THEN value END), 0), 6) AS "SMALL_Sum"
FROM scope_spine s JOIN fr USING (county_key) JOIN questions q USING (question_id)
WHERE category IN ('PROMO', 'SMALL') GROUP BY {META}""",
    "wide_code_merge": _with(_scope_spine(ALL), census_wide_cte(ALL, [11]), score_wide_cte(["PROMO"])) + """
SELECT * REPLACE ('9990' || lpad(ltrim(county_id, '0'), 9, '0') AS county_id)
FROM cw FULL JOIN (SELECT * EXCLUDE (state_name, county_name) FROM sw) r USING (state_id, county_id)""",
    "census_duplicate_check": _with() + "SELECT county_key, variable_id, 2 * count(*) AS n_rows FROM cf WHERE variable_id = 12 GROUP BY ALL",
    "census_wide_states": census_wide("state:" + R.STATE_ABBREVS, R.BASIC_VARIABLES),
    "census_long_states": census_long("state:N00, n03,N07", R.ALL_VARIABLES),
    "score_wide_states": score_wide("state:" + R.STATE_ABBREVS, R.SUM_CATEGORIES),
    "export_states": export_sql("state:N00, n03,N07"),
    "export_states_snapshot": export_sql("state:N00, n03,N07"),
    "score_blocks_county": _with(_scope_spine(COUNTY), matrix_cte(R.DETAIL_QUESTIONS, R.DETAIL_CATEGORY + "_Sum", "em"),
                                 score_wide_cte(R.SUM_CATEGORIES, "sw")) +
    "SELECT * FROM " + _outer_merge([("em", matrix_expr(R.DETAIL_CATEGORY + "_Sum", R.DETAIL_QUESTIONS, "em")), ("sw", "sw")]) + " mg",
    "density": _density_sql(None),
    "density_band": _density_sql(None, with_band=True),
    "density_rural": _density_sql("Rural"),
    "density_suburban": _density_sql("Suburban"),
    "density_urban": _density_sql("Urban"),
    "header_lookup": _with() + f"""SELECT {_LABEL.replace('label', 'name')} AS key, arg_max(header, ordinal) AS header
FROM header_dictionary GROUP BY ALL""",
    "header_apply": header_apply_sql(),
    "header_csv": _with() + f"""SELECT {_LABEL.replace('label', 'name')} AS key, arg_max(header, ordinal) AS header
FROM header_dictionary GROUP BY ALL""",
    "category_labels": _with() + """SELECT DISTINCT category, coalesce(label, category) AS label FROM (
  SELECT category FROM questions UNION ALL
  SELECT ['Reg', 'Voting', 'Abuses', 'pollworkers', 'Registration', 'dropboxes', 'Vote Centers', 'Ease of Registration'][question_id % 8 + 1] FROM questions)
LEFT JOIN (VALUES
  ('Reg', 'The Provision of Information About Registration (5 item additive scale)'),
  ('Voting', 'The Provision of Information About Voting'),
  ('Abuses', 'History of Voting Rights Abuses in County (3 item Likert scale)'),
  ('pollworkers', 'Availability of Poll Workers (6 item additive scale)'),
  ('Registration', 'Registration Drives (dichotomous 0/1)'),
  ('dropboxes', 'Alternative Voting: Drop Boxes (dichotomous 0/1)'),
  ('Vote Centers', 'Alternative Voting: Vote Centers (dichotomous 0/1)'),
  ('Ease of Registration', 'Ease of Registration (4 item additive scale)')) m(category, label) USING (category)""",
    "export_row_count": f"SELECT count(*) AS n_rows FROM ({export_sql(ALL)})",
    "profile_numeric": profile_sql(False),
    "profile_extended": profile_sql(True),
    "profile_default3": f"""SELECT * FROM ({profile_sql(True)}) WHERE "column" IN
  ('1: Overall Population', '11: Order value 1-URGENT', '12: Order value 2-HIGH')""",
    "export_job": f"""SELECT 'data' AS part, county_id || '|' || name AS name, round(v, 6) AS value
FROM ({export_sql(ALL, band="Suburban")}) UNPIVOT INCLUDE NULLS
  (v FOR name IN (COLUMNS(* EXCLUDE (state_id, state_name, county_id, county_name))))
UNION ALL SELECT 'columns', "column" || '|' || "group", ordinal::DOUBLE FROM ({header_apply_sql()})
UNION ALL SELECT 'profile', "column", median FROM ({profile_sql(False, export_sql(ALL, band="Suburban"))})""",
    "export_state_scope": export_sql(ALL),
    "export_state_band": export_sql(ALL, band="Suburban"),
    "export_state_only": export_sql(ALL, state_only=True),
    "export_county_scope": export_sql(COUNTY),
    "export_csv_roundtrip": export_sql(ALL),
    "export_snapshot_roundtrip": export_sql(ALL),
}

_JOINED = "FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
assert _JOINED in FIXTURE


def _responses_where(sql: str, condition: str) -> str:
    """The same query over the responses of some order lines only."""
    return sql.replace(_JOINED, _JOINED[:-1] + f" WHERE {condition})")


_MERGED = _with(_scope_spine(ALL),
                census_wide_cte(ALL, [1, 11], "b1a"), census_wide_cte(ALL, [11, 12], "b2a"),
                score_wide_cte(["PROMO"], "b3"), score_wide_cte(["SMALL", "PROMO"], "b4a")) + f"""
SELECT * FROM (SELECT * FROM b1a WHERE state_id IN ('00', '03', '07')) b1
FULL JOIN (SELECT * EXCLUDE (state_name, county_name, "11: Order value 1-URGENT") FROM b2a) b2 USING (state_id, county_id)
FULL JOIN (SELECT * EXCLUDE (state_name, county_name) FROM b3) b3 USING (state_id, county_id)
FULL JOIN (SELECT * EXCLUDE (state_name, county_name, "PROMO_Sum") FROM b4a WHERE state_id IN ('03', '07')) b4 USING (state_id, county_id)"""

ORACLE |= {
    "snapshot_versions": f"""SELECT *, 1 AS version FROM ({score_wide(ALL, R.SUM_CATEGORIES)})
UNION ALL SELECT *, 2 FROM ({_responses_where(score_wide(ALL, R.SUM_CATEGORIES), "l_quantity > 25")})""",
    "export_bucketed": export_sql(ALL),
    "score_incremental": _responses_where(score_wide(ALL, R.SUM_CATEGORIES), "l_returnflag <> 'R'"),
    "question_incremental": _responses_where(question_long_dense(ALL, R.MATRIX_QUESTIONS), "l_returnflag <> 'R'"),
    "merge_blocks": _MERGED,
    "profile_states": profile_sql(True, export_sql("state:N00, n03,N07")).replace(", 6) AS", ", 4) AS"),
    "export_reuse": export_sql_for("state:N00, n03,N07", [11, 12], [(R.DETAIL_CATEGORY, list(R.DETAIL_QUESTIONS))], ["SMALL"],
                                   [R.STATE_COLUMNS[1]], "Suburban"),
    "measure_rejects": _with() + """, z AS (
  SELECT 'census_facts' AS relation, CASE WHEN variable_id = 43 AND data LIKE '%7' THEN 'not a number' ELSE 'ok' END AS reason FROM census_facts
  UNION ALL
  SELECT 'responses', CASE WHEN l_linenumber = 5 THEN 'no region code' WHEN l_returnflag = 'R' THEN 'not a number' ELSE 'ok' END
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT relation, reason, count(*) AS n_observed, count(*) AS n_written FROM z GROUP BY ALL""",
    "export_download": export_sql(ALL),
    "header_files": _with() + f"""SELECT key, arg_max(header, place) AS header FROM (
  SELECT {_LABEL.replace('label', 'name')} AS key, header, ordinal + 1 AS place FROM header_dictionary
  UNION ALL SELECT {_LABEL.replace('label', 'category')}, 'Category', 0 FROM questions
  UNION ALL SELECT {_LABEL.replace('label', 'question')}, 'Question', -1 FROM questions) GROUP BY key""",
    "catalogue_search_index": _with() + f"""SELECT query, question_id, strpos(t, q)::INTEGER - 1 AS first_place,
  len(list_filter(range(length(t)), lambda i: substr(t, i + 1, length(q)) = q)) AS n_places
FROM (SELECT question_id, lower(question) AS t, query, lower(trim(query)) AS q
      FROM questions, (SELECT UNNEST([{_lit_list(R.SEARCH_TEXTS)}]) AS query)) WHERE contains(t, q)""",
    "long_list_facts": _with() + """SELECT county_key, count(*) AS n, SUM(value) AS total FROM cr
WHERE county_key IN (SELECT ltrim(CAST(c_custkey AS STRING), '0') FROM customer WHERE c_acctbal < 0) GROUP BY county_key""",
}
