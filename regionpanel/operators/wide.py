"""Long -> wide reshapes: census blocks (A1-A4) and the state projection.

``pivot_by_key`` is the one pivot used everywhere. It aggregates by
``county_key`` only (names join later), with explicit key values so the
schema depends on the request alone and no distinct job is needed:

* up to ``CONDITIONAL_LIMIT`` keys: one aggregate of conditional
  expressions — a single exchange, partial aggregation map side;
* more keys: aggregate by (county, key) first, then Spark's pivot with
  explicit values — O(1) work per input row however wide the result; totals
  are one ``aggregate(array(...))`` expression, never a deep addition chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionpanel.functions.keys import in_list, name_key, qcol, quote, select_sql, sum_sql
from regionpanel.operators.dimension import by_county, county_dimension, scoped_facts, sized_spine
from regionpanel.plans.spec import Scope
from regionpanel.sources.schema import META, MANDATORY_VARIABLES
from regionpanel.sources.tables import Tables

CONDITIONAL_LIMIT = 64


def pivot_by_key(long: DataFrame, key: str, value: str, labels: dict, how: str = "max",
                 group: str = "county_key", total: str | None = None) -> DataFrame:
    """``group`` + one column per ``labels`` entry (key value -> column name).

    ``how`` is ``sum``, ``max`` (the largest of a cell's values) or
    ``unique`` (the aggregate itself fails on a cell with two values, so no
    extra pass is needed to notice them); a missing cell is NULL.
    ``total`` names an extra column holding the sum of all values of the
    group (one aggregate, not a chain of column additions).
    """
    agg = F.sum if how == "sum" else F.max

    def checked(cell, twice):
        text = f"duplicate facts of one {group} for {key} "
        return F.when(twice, F.raise_error(F.lit(text)).cast("double")).otherwise(cell) if how == "unique" else cell

    if not labels:
        return long.select(group).distinct()
    extra = [F.sum(value).alias(total)] if total else []
    if len(labels) <= CONDITIONAL_LIMIT:
        k = F.col(key)
        # a bit per key: a group with more rows than bits has a cell twice. One pair of
        # aggregates serves all cells
        slot = F.array_position(F.array(*[F.lit(v) for v in labels]), k).cast("int")
        bit = F.when(slot > 0, F.call_function("shiftleft", F.lit(1).cast("long"), slot - 1))
        twice = F.count(bit) > F.coalesce(F.bit_count(F.bit_or(bit)), F.lit(0))
        return long.groupBy(group).agg(
            *[checked(agg(F.when(k == F.lit(v), F.col(value))), twice).alias(lbl) for v, lbl in labels.items()], *extra)
    # wide request: O(1) work per input row. Cells per (group, key) first,
    # then Spark's pivot with explicit values (PivotFirst: each cell goes to
    # its slot by a hash lookup, not a scan of the keys).
    cell = long.groupBy(group, key).agg(checked(agg(value), F.count(F.lit(1)) > 1).alias("_cell"))
    # numbered partitions: AQE would size the pivot stage by its narrow input
    # and may squeeze it into one task, though its output is wide
    n = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wide = cell.repartition(n, group).groupBy(group).pivot(key, list(labels)).agg(F.first("_cell"))
    slots = [quote(str(v)) for v in labels]
    exprs = [quote(group), *[f"{slot} AS {quote(lbl)}" for slot, lbl in zip(slots, labels.values())]]
    if total:
        exprs.append(f"{sum_sql(slots)} AS {quote(total)}")
    return select_sql(wide, exprs)


# --------------------------------------------------------------- variables

def resolve_census_variables(tables: Tables, requested, mandatory: bool = False) -> dict[int, str]:
    """Requested variables -> ordered {id: stored name} (ordered by id).

    Names match case- and space-insensitively (K6); ints match ids. With
    ``mandatory`` the population and land-area variables are added if they
    exist (L7). Only the matching dictionary rows reach the driver.
    """
    names, ids = [], []
    for item in requested or ():
        if isinstance(item, int) or (isinstance(item, str) and item.strip().isdigit()):
            ids.append(int(item))
        elif str(item).strip():
            names.append(str(item).strip().lower())
    if mandatory:
        names += [m.lower() for m in MANDATORY_VARIABLES]
    if not names and not ids:
        return {}
    names, ids = tuple(sorted(set(names))), tuple(sorted(set(ids)))

    def lookup():
        cond = F.lit(False)
        if names:
            cond = cond | name_key("variable_name").isin(list(names))
        if ids:
            cond = cond | in_list("variable_id", ids)
        rows = (tables.census_variables.where(cond).select("variable_id", "variable_name")
                .distinct().orderBy("variable_id").collect())
        return {r.variable_id: r.variable_name for r in rows}

    return dict(tables.memo(("census_variables", names, ids), lookup))


def variable_label(vid: int, name: str) -> str:
    return f"{vid}: {name}"


# ------------------------------------------------------------------ census (A1-A3)

def census_long(tables: Tables, scope: Scope, variables: dict[int, str]) -> DataFrame:
    """Facts of the chosen variables in scope, one row per county x variable."""
    spine = sized_spine(tables, scope)
    facts = scoped_facts(tables.census_facts, tables, scope)
    facts = facts.where(in_list("variable_id", variables))
    return (
        facts.join(spine, "county_key", "inner")
        .join(tables.census_variables, "variable_id", "inner")
        .select(*META, "variable_id", "variable_name", "value")
    )


def census_block(tables: Tables, scope: Scope, variables: dict[int, str], duplicates: str = "raise") -> DataFrame:
    """county_key + one column per variable (NULL where missing); only
    counties with at least one chosen fact. A second fact of one county and
    variable fails the job (as the reference's pivot does) unless
    ``duplicates="largest"`` asks to keep the largest."""
    if duplicates not in ("raise", "largest"):
        raise ValueError("duplicates must be 'raise' or 'largest'")
    labels = {vid: variable_label(vid, name) for vid, name in variables.items()}
    return by_county(tables, "census_facts", scope, lambda facts: pivot_by_key(
        facts.where(in_list("variable_id", variables)).select("county_key", "variable_id", "value"),
        "variable_id", "value", labels, "unique" if duplicates == "raise" else "max"))


def census_wide(tables: Tables, scope: Scope, variables: dict[int, str], duplicates: str = "raise") -> DataFrame:
    """A3: one row per county in scope with at least one chosen fact.

    Deviation: a requested variable without any fact is a NULL column (the
    schema depends on the request only). ``duplicates``: see ``census_block``."""
    spine = sized_spine(tables, scope)
    block = census_block(tables, scope, variables, duplicates)
    cols = [variable_label(v, n) for v, n in variables.items()]
    return select_sql(spine.join(block, "county_key", "inner"), [*META, *[quote(c) for c in cols]])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Uniqueness check of a pivot key: key combinations with more than one
    row, and how many (partial counts map side, so hot keys stay cheap)."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
            .where(F.col("n_rows") > 1))


def pivot_duplicates(tables: Tables, variables: dict[int, str] | None = None,
                     scope: Scope | None = None) -> DataFrame:
    """(county, variable) pairs with more than one census fact (within the
    scope and variables, when given); the reference's pivot raises on these,
    ours reports them."""
    facts = tables.census_facts if scope is None else scoped_facts(tables.census_facts, tables, scope)
    if scope is not None and scope.kind == "state" and not scope.all_states and "state_key" not in facts.columns:
        keys = county_dimension(tables, scope).select("county_key")
        facts = facts.join(keys, "county_key", "left_semi")
    if variables:
        facts = facts.where(in_list("variable_id", variables))
    return duplicate_keys(facts, ["county_key", "variable_id"])


# ----------------------------------------------------------- state projection

def state_wide_select(tables: Tables, state_keys: DataFrame | None, columns: list[str]) -> DataFrame:
    """Chosen columns of the wide state table, in requested order, for the
    states in ``state_keys`` (a DataFrame with ``state_key``; None = all).

    Unknown column names raise before any job runs."""
    have = set(tables.state_variable_columns())
    missing = [c for c in columns if c not in have]
    if missing:
        raise KeyError(f"unknown state variables: {missing}")
    sw = tables.state_wide
    if state_keys is not None:
        sw = sw.join(state_keys.select("state_key").distinct(), "state_key", "left_semi")
    return sw.select("state_id", *[qcol(c) for c in columns])
