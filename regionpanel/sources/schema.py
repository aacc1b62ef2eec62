"""Schemas of the input relations (stored form) and of the canonical form."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- stored form (what a snapshot or an upstream system holds) -----------------

STATES = T.StructType([
    T.StructField("state_id", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("abbrev", T.StringType(), False),
])

COUNTIES = T.StructType([
    T.StructField("county_id", T.StringType(), False),
    T.StructField("state_id", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
])

CENSUS_VARIABLES = T.StructType([
    T.StructField("variable_id", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
])

CENSUS_FACTS = T.StructType([
    T.StructField("county_id", T.StringType(), False),
    T.StructField("variable_id", T.IntegerType(), False),
    T.StructField("data", T.StringType(), True),
])

QUESTIONS = T.StructType([
    T.StructField("question_id", T.LongType(), False),
    T.StructField("question", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
])

RESPONSES = T.StructType([
    T.StructField("county_id", T.StringType(), False),
    T.StructField("question_id", T.LongType(), False),
    T.StructField("value", T.StringType(), True),
])

HEADER_DICTIONARY = T.StructType([
    T.StructField("name", T.StringType(), True),
    T.StructField("header", T.StringType(), True),
])

STORED = {
    "states": STATES,
    "counties": COUNTIES,
    "census_variables": CENSUS_VARIABLES,
    "census_facts": CENSUS_FACTS,
    "questions": QUESTIONS,
    "responses": RESPONSES,
}

# ---- output meta columns of every county-level result -------------------------

META = ["state_id", "state_name", "county_id", "county_name"]

# Census variables that every export carries (population density needs both).
POPULATION = "Overall Population"
LAND_AREA = "Land Area in Square Miles"
POPULATION_ID = 1
LAND_AREA_ID = 43
MANDATORY_VARIABLES = (LAND_AREA, POPULATION)
