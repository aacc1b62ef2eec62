"""Dictionary lookups and catalogue scans.

Each lookup takes the request either as a Python list (user input: bounded,
turned into a literal ``IN`` or a broadcast semi join) or as a DataFrame of
requested values (a request table, joined as a semi join of any size).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionpanel.functions.keys import STATE_WIDTH, name_key, pad_code
from regionpanel.operators.dimension import keep_keys, scoped_states
from regionpanel.plans.spec import Scope
from regionpanel.sources.schema import MANDATORY_VARIABLES
from regionpanel.sources.tables import Tables


# ------------------------------------------------------------------ scans

def column_values(df: DataFrame, column) -> DataFrame:
    """Projection of one or more columns, duplicates kept, no order."""
    if isinstance(column, str):
        return df.select(column)
    if isinstance(column, (list, tuple)):
        return df.select(*column)
    raise TypeError("column must be a string or a list of strings")


def state_variable_names(tables: Tables) -> list[str]:
    """Measures of the wide state table (schema only, no job)."""
    return tables.state_variable_columns()


def state_variable_list(tables: Tables) -> DataFrame:
    """S4 as a relation: state variables with at least one state row."""
    cols = tables.state_variable_columns()
    long = tables.state_wide.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols]) \
        .unpivot([], cols, "variable", "value")
    return long.groupBy("variable").agg(F.count(F.lit(1)).alias("n_states"))


# ---------------------------------------------------------------- lookups

def _match(df: DataFrame, key_expr, request, request_key: str = "key") -> DataFrame:
    """Rows of ``df`` whose ``key_expr`` is in the request (list or DataFrame)."""
    keyed = df.withColumn("_k", key_expr)
    if isinstance(request, DataFrame):
        req = request.select(F.col(request_key).alias("_k")).distinct()
        return keyed.join(req, "_k", "left_semi").drop("_k")
    return keep_keys(keyed, "_k", list(request)).drop("_k")


def state_ids(tables: Tables, abbrevs) -> DataFrame:
    """L1: padded state ids for abbreviations (unknown ones dropped)."""
    return scoped_states(tables, Scope.states(abbrevs)).select("state_id").orderBy("state_id")


def states_of_counties(tables: Tables, codes) -> DataFrame:
    """L2: distinct padded state ids of the counties typed."""
    keys = Scope.counties(codes).county_keys()
    return (keep_keys(tables.counties, "county_key", keys)
            .select(pad_code("state_key", STATE_WIDTH).alias("state_id")).distinct().orderBy("state_id"))


def county_names(tables: Tables, codes) -> DataFrame:
    """L3: names of the counties typed, ordered by name (not distinct)."""
    keys = Scope.counties(codes).county_keys()
    return keep_keys(tables.counties, "county_key", keys).select("county_name").orderBy("county_name")


def question_lookup(tables: Tables, names) -> DataFrame:
    """L4: questions whose text matches, case/space-insensitive, in any
    category; ordered by id."""
    req = names.select(name_key("name").alias("key")) if isinstance(names, DataFrame) else \
        [str(n).strip().lower() for n in names if str(n).strip()]
    return _match(tables.questions, name_key("question"), req).select("question_id", "question") \
        .orderBy("question_id")


def census_variable_lookup(tables: Tables, names) -> DataFrame:
    """Census variables whose name matches; ordered by id."""
    req = names.select(name_key("name").alias("key")) if isinstance(names, DataFrame) else \
        [str(n).strip().lower() for n in names if str(n).strip()]
    return _match(tables.census_variables, name_key("variable_name"), req) \
        .select("variable_id", "variable_name").orderBy("variable_id")


def mandatory_variables(tables: Tables, requested) -> DataFrame:
    """Requested variables plus population and land area (if they exist).

    ``requested`` is a list of names or a DataFrame with a ``name`` column."""
    if isinstance(requested, DataFrame):
        spark = requested.sparkSession
        fixed = spark.createDataFrame([(m,) for m in MANDATORY_VARIABLES], "name string")
        return census_variable_lookup(tables, requested.select("name").unionByName(fixed))
    names = [str(n).strip().lower() for n in requested if str(n).strip()]
    names += [m.lower() for m in MANDATORY_VARIABLES]
    return census_variable_lookup(tables, names)


def fact_variable_names(tables: Tables) -> DataFrame:
    """S2 over the fact table: the variable name of every census fact,
    duplicates kept, no order."""
    return tables.census_facts.join(tables.census_variables, "variable_id", "inner") \
        .select(F.col("variable_name").alias("name"))


def catalogue_search(df: DataFrame, column: str, query: str) -> DataFrame:
    """Case-insensitive substring search; an empty query keeps all."""
    q = (query or "").strip().lower()
    return df if not q else df.where(F.lower(F.col(column)).contains(q))


def question_categories(tables: Tables) -> DataFrame:
    """Distinct categories, ordered by their first question id."""
    return (tables.questions.groupBy("category")
            .agg(F.min("question_id").alias("first_question_id")).orderBy("first_question_id"))


def questions_in_category(tables: Tables, category: str) -> DataFrame:
    """Question texts of one category."""
    return tables.questions.where(F.col("category") == F.lit(category)).select("question_id", "question")

