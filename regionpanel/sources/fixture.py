"""Mapping of the driver's TPC-H-like test tables onto the star schema.

The test data has no census or survey tables; this module derives them
(FIXTURES.md §2) so that every query runs over the whole given tables and
its work grows with them. Keys are stored in deliberately clashing forms
(states unpadded, county state references padded) so that key
canonicalisation is exercised on real volume.

| relation          | derived from                                                  |
| states            | nation: id unpadded, abbrev ``N`` + 2-digit key                |
| counties          | customer: id unpadded, state reference padded to 2             |
| census_variables  | fixed rows below                                               |
| census_facts      | orders per customer (total and per priority), 3*|acctbal|     |
| questions         | part: name ``p_name #p_partkey``, category ``p_type``          |
| responses         | orders join lineitem: customer, part, quantity                 |
| state_wide        | supplier per nation: count and top balance                     |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionpanel.functions.keys import pad_code
from regionpanel.sources import schema as S
from regionpanel.sources.tables import Tables

# Fixed values of the mapping (FIXTURES.md §2).
CENSUS_VARIABLE_ROWS = [
    (1, "Overall Population"),
    (11, "Order value 1-URGENT"),
    (12, "Order value 2-HIGH"),
    (13, "Order value 3-MEDIUM"),
    (14, "Order value 4-NOT SPECIFIED"),
    (15, "Order value 5-LOW"),
    (43, "Land Area in Square Miles"),
]
PRIORITY_VARIABLE_BASE = 10          # variable id = 10 + first digit of o_orderpriority
PRIORITY_DIGITS = ["1", "2", "3", "4", "5"]
LAND_AREA_FACTOR = 3                 # land area = 3 * |c_acctbal|
STATE_COUNT_COLUMN = "Supplier count(0-n)"
STATE_BALANCE_COLUMN = "Top balance($)"
MONEY = "decimal(18,2)"


def _read(spark: SparkSession, sf_dir: str, name: str, cols: list[str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def stored_relations(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Stored-form relations (schemas of ``regionpanel.sources.schema``)."""
    nation = _read(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    customer = _read(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal"])
    orders = _read(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"])
    lineitem = _read(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_quantity"])
    part = _read(spark, sf_dir, "part", ["p_partkey", "p_name", "p_type"])
    supplier = _read(spark, sf_dir, "supplier", ["s_nationkey", "s_acctbal"])

    states = nation.select(
        F.col("n_nationkey").cast("string").alias("state_id"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("N"), pad_code("n_nationkey", 2)).alias("abbrev"),
    )
    counties = customer.select(
        F.col("c_custkey").cast("string").alias("county_id"),
        pad_code("c_nationkey", 2).alias("state_id"),
        F.col("c_name").alias("name"),
    )
    census_variables = spark.createDataFrame(CENSUS_VARIABLE_ROWS, S.CENSUS_VARIABLES)

    # One pass over orders: total and per-priority sums per customer, exact.
    money = F.col("o_totalprice").cast(MONEY)
    digit = F.substring("o_orderpriority", 1, 1)
    per_customer = orders.groupBy("o_custkey").agg(
        F.sum(money).alias("v1"),
        *[F.sum(F.when(digit == d, money)).alias(f"v{PRIORITY_VARIABLE_BASE + int(d)}")
          for d in PRIORITY_DIGITS],
    )
    value_cols = ["v1"] + [f"v{PRIORITY_VARIABLE_BASE + int(d)}" for d in PRIORITY_DIGITS]
    order_facts = (
        per_customer.unpivot("o_custkey", value_cols, "var", "amount")
        .where(F.col("amount").isNotNull())
        .select(
            F.col("o_custkey").cast("string").alias("county_id"),
            F.substring("var", 2, 3).cast("int").alias("variable_id"),
            F.col("amount").cast(MONEY).cast("string").alias("data"),
        )
    )
    area_facts = customer.select(
        F.col("c_custkey").cast("string").alias("county_id"),
        F.lit(S.LAND_AREA_ID).cast("int").alias("variable_id"),
        (F.lit(LAND_AREA_FACTOR) * F.abs(F.col("c_acctbal").cast(MONEY))).cast(MONEY)
        .cast("string").alias("data"),
    )
    census_facts = order_facts.unionByName(area_facts)

    questions = part.select(
        F.col("p_partkey").cast("long").alias("question_id"),
        F.concat(F.col("p_name"), F.lit(" #"), F.col("p_partkey").cast("string")).alias("question"),
        F.col("p_type").alias("category"),
    )
    responses = (
        orders.select("o_orderkey", "o_custkey")
        .join(lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "inner")
        .select(
            F.col("o_custkey").cast("string").alias("county_id"),
            F.col("l_partkey").cast("long").alias("question_id"),
            F.col("l_quantity").cast("string").alias("value"),
        )
    )
    state_wide = supplier.groupBy("s_nationkey").agg(
        F.count(F.lit(1)).cast("double").alias(STATE_COUNT_COLUMN),
        F.max("s_acctbal").cast("double").alias(STATE_BALANCE_COLUMN),
    ).select(pad_code("s_nationkey", 2).alias("state_id"), STATE_COUNT_COLUMN, STATE_BALANCE_COLUMN)

    return {
        "states": states, "counties": counties, "census_variables": census_variables,
        "census_facts": census_facts, "questions": questions, "responses": responses,
        "state_wide": state_wide,
    }


# Header groups of the fixture dictionary (FIXTURES.md §2).
HEADER_CENSUS = "Census Variables"
HEADER_SCORES = "Score sums"
HEADER_STATE = "State variables"
HEADER_META = "identifier"


def header_dictionary(spark: SparkSession, stored: dict[str, DataFrame]) -> DataFrame:
    """(ordinal, name, header): variable names, category names (from the
    questions), state columns and the four meta columns."""
    fixed = (
        [(i, name, HEADER_CENSUS) for i, (_, name) in enumerate(CENSUS_VARIABLE_ROWS)]
        + [(100, STATE_COUNT_COLUMN, HEADER_STATE), (101, STATE_BALANCE_COLUMN, HEADER_STATE)]
        + [(200 + i, m, HEADER_META) for i, m in enumerate(S.META)]
    )
    fixed_df = spark.createDataFrame(fixed, "ordinal long, name string, header string")
    categories = (
        stored["questions"].select(F.col("category").alias("name")).distinct()
        .select(F.lit(50).cast("long").alias("ordinal"), "name", F.lit(HEADER_SCORES).alias("header"))
    )
    return fixed_df.unionByName(categories)


def fixture_tables(spark: SparkSession, sf_dir: str) -> Tables:
    stored = stored_relations(spark, sf_dir)
    return Tables.from_stored(
        **stored, header_dictionary=header_dictionary(spark, stored)
    )
