"""Facts that cannot be used, told apart while they are loaded (K7).

The reference turns a measure that is no number into nothing, silently.
``split_facts`` writes a fact relation once, each row under the reason for
which it is refused (``ok`` for the others): one scan gives the usable facts,
the quarantined rows as they were stored, and - as observed metrics of the same
job - how many there are of each reason.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from regionpanel.functions.keys import trim_ws
from regionpanel.functions.measures import rejected
from regionpanel.session import checkpoint_dir

OK = "ok"
NO_REGION, NO_KEY, NO_NUMBER = "no region code", "no variable or question", "not a number"
#: relation -> (key column, its type, measure column)
FACTS = {"census_facts": ("variable_id", "int", "data"), "responses": ("question_id", "long", "value")}


@dataclass(frozen=True)
class Loaded:
    facts: DataFrame          # usable rows, stored columns
    quarantine: DataFrame     # relation, reason, region, key and measure as stored
    counts: dict              # reason -> rows, as observed by the write


def reason(key: str, kind: str, value: str) -> Column:
    """Why a stored fact is refused, or ``ok``; the first that applies."""
    region = F.col("county_id").cast("string")
    return (F.when(region.isNull() | (trim_ws(region) == ""), NO_REGION)
            .when(F.col(key).isNull() | F.col(key).try_cast(kind).isNull(), NO_KEY)
            .when(rejected(value), NO_NUMBER).otherwise(OK))


def split_facts(relation: str, stored: DataFrame, folder: str | None = None) -> Loaded:
    """Write ``stored`` once below ``folder`` (the checkpoint folder by default), told apart by reason."""
    spark = stored.sparkSession
    key, kind, value = FACTS[relation]
    path = f"{folder or checkpoint_dir(spark)}/{relation}-{uuid.uuid4().hex}"
    seen = Observation(f"{relation}-{uuid.uuid4().hex}")
    why = F.col("reason")
    told = stored.withColumn("reason", reason(key, kind, value))
    told = told.observe(seen, *[F.count(F.when(why == r, 1)).alias(r) for r in (OK, NO_REGION, NO_KEY, NO_NUMBER)])
    told.write.partitionBy("reason").parquet(path)
    from pyspark.sql import types as T
    schema = T.StructType([*stored.schema.fields, T.StructField("reason", T.StringType())])
    back = spark.read.schema(schema).parquet(path)
    refused = back.where(why != OK).select(F.lit(relation).alias("relation"), "reason", F.col("county_id").cast("string").alias("county_id"),
                                           F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"))
    return Loaded(back.where(why == OK).drop("reason"), refused, dict(seen.get))


def load_facts(stored: dict, folder: str | None = None):
    """(stored relations with usable facts only, quarantined rows of both fact
    relations, counts by relation and reason); each fact relation is scanned once."""
    loaded = {r: split_facts(r, stored[r], folder) for r in FACTS}
    refused = loaded["census_facts"].quarantine.unionByName(loaded["responses"].quarantine)
    return (stored | {r: x.facts for r, x in loaded.items()}, refused, {r: x.counts for r, x in loaded.items()})
