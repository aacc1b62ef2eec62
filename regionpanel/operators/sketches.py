"""Mergeable quantile sketches of a written export, per state.

``write_sketches`` keeps, for every state of a wide frame, one KLL sketch and
one count per numeric column: a single aggregate by state.  ``profile_from``
answers the profile of any set of states from them: the sketches of those
states are merged (they are small and their number is the number of states),
the merged sketch gives a bracket of values around each wanted rank, and ONE
pass over the rows of those states counts and lists what lies in the brackets
and takes the simple statistics.  The result is exact: the sketch only says
where to look.  A rank outside its bracket (the sketch's error bound holds with
99 % probability) shows in the counts; that column and quantile then starts
again from the column's least and largest value.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionpanel.functions.keys import in_list, qcol
from regionpanel.operators import profile as P

#: KLL parameter: a larger sketch errs less (rank error about 2.3 / K ** 0.97)
K = 2000
ERROR = 2.296 / K ** 0.9723
GROUP = "state_id"


def sketch_rows(df: DataFrame, group: str = GROUP, cols: list[str] | None = None) -> DataFrame:
    """(group, column, count, sketch): one row per group and numeric column."""
    cols = P.numeric_columns(df) if cols is None else cols
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], f"`{group}` string, column string, count long, sketch binary")
    value = lambda c: F.nullif(qcol(c).cast("double"), F.lit(float("nan")))
    aggs = [x for i, c in enumerate(cols) for x in (F.count(value(c)).alias(f"n{i}"), F.kll_sketch_agg_double(value(c), F.lit(K)).alias(f"s{i}"))]
    wide = df.groupBy(group).agg(*aggs)
    return wide.select(group, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("count"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(cols)])))


def write_sketches(df: DataFrame, path: str, group: str = GROUP) -> None:
    sketch_rows(df, group).write.mode("overwrite").parquet(path)


def _scoped(df: DataFrame, group: str, members) -> DataFrame:
    return df if members is None else df.where(in_list(group, sorted(set(members))))


def brackets(sketches: DataFrame, cols: list[str], probs: list[float], members=None, group: str = GROUP) -> dict[str, dict]:
    """column -> count, and per probability the values that enclose its ranks."""
    rows = (_scoped(sketches, group, members).where(F.col("count") > 0).groupBy("column")
            .agg(F.sum("count").alias("count"), F.kll_merge_agg_double("sketch").alias("sketch")))
    around = [x for p in probs for x in (p - ERROR, p + ERROR)]
    inside = [min(1.0, max(0.0, x)) for x in around]
    got = rows.select("column", "count", F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(x) for x in inside])).alias("q")).collect()
    out = {}
    for r in got:
        if r.column in cols:
            out[r.column] = {"count": r["count"], "near": {p: (-math.inf if around[2 * j] <= 1 / r["count"] else r.q[2 * j],
                                                              math.inf if around[2 * j + 1] >= 1 - 1 / r["count"] else r.q[2 * j + 1])
                                                          for j, p in enumerate(probs)}}
    return out


def profile_from(df: DataFrame, sketches: DataFrame, members=None, quartiles: bool = False, digits: int | None = None,
                 cols: list[str] | None = None, group: str = GROUP) -> DataFrame:
    """``profile.profile`` of the rows of ``df`` whose ``group`` is among ``members`` (all by default),
    with brackets from the stored sketches and one pass over those rows."""
    cols = P.numeric_columns(df) if cols is None else cols
    probs = P.probabilities(quartiles)
    near = brackets(sketches, cols, probs, members, group)
    values = P.values_of(_scoped(df, group, members), cols)
    stats = []
    for c in cols:
        s = near.get(c, {"count": 0, "near": {}})
        stats.append({"count": s["count"], "near": s["near"], "span": 2 * ERROR * s["count"] + 4})
    simple, counted = P.first_pass(values, stats, probs)
    for s, row in zip(stats, simple):
        if s["count"] != row["count"]:
            raise RuntimeError("the sketches are not of this table: counts differ")
        s |= row
    return P.report(df.sparkSession, cols, stats, P.order_statistics(values, stats, probs, counted, retry=True), quartiles, digits)
