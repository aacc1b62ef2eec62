"""Numeric profile of an export.

One row per numeric column: count (non-NULL), mean, sample std, min,
exact median, max; the extended form adds the 25 / 50 / 75 % quantiles
(linear interpolation between order statistics, as pandas and DuckDB's
``quantile_cont``: ``lo + (hi - lo) * frac``).

The data stays columnar and no column is gathered in one task:

1. ONE global aggregate (partials per task) gives count, mean, std, min, max
   of every column and a value bracket around each wanted order statistic,
   from ``percentile_approx`` or from stored sketches (``sketches.py``);
2. a second aggregate counts, for each bracket, the values below it, those
   equal to its ends and those strictly between, and lists the latter where the
   bracket's ranks say that they are at most ``GATHER``.  Heavy ties sit at an
   end, where a count is enough; the wanted ranks are read off;
3. a bracket with more values between its ends is narrowed to order statistics
   of just those (each pass divides them by thousands).  New ends are values
   from strictly between the old ones, so every pass makes the bracket smaller,
   infinite values and the largest doubles included, and the passes end.

The driver sees a few numbers per column (schema-sized). If a bracket ever
misses a wanted rank the profile fails rather than report a wrong quantile.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionpanel.functions.keys import quote, select_sql

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
ACCURACY = 10000
GATHER = 2000


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def values_of(df: DataFrame, cols: list[str]) -> DataFrame:
    """The numeric columns as doubles ``v0, v1, ...``; NaN becomes NULL (pandas skips it)."""
    return select_sql(df, [f"nullif(CAST({quote(c)} AS DOUBLE), CAST('NaN' AS DOUBLE)) AS v{i}" for i, c in enumerate(cols)])


def _interpolated(low: float, high: float, share: float) -> float:
    return low if low == high or not share else low + (high - low) * share


def _opened(stats: list[dict], probs: list[float]) -> dict:
    """(column number, probability) -> wanted ranks and first bracket, for columns with values."""
    out = {}
    for i, s in enumerate(stats):
        for p in probs if s["count"] else ():
            pos = p * (s["count"] - 1)
            lo, hi = s["near"][p]
            out[i, p] = {"share": pos - math.floor(pos), "k": (math.floor(pos), math.ceil(pos)), "lo": lo, "hi": hi, "span": s["span"]}
    return out


def order_statistics(values: DataFrame, stats: list[dict], probs: list[float], counted: dict | None = None, retry: bool = False) -> dict:
    """(column number, probability) -> exact interpolated quantile.

    ``stats`` holds for each column its ``count`` and, for each probability, a
    bracket of values (``near``) and how many ranks it is expected to span.
    ``counted`` are the first brackets' counts, if a pass took them already.
    A bracket that misses its ranks is an error, or (``retry``) starts again
    from the column's ``min`` and ``max``."""
    found = {(i, p): None for i, s in enumerate(stats) for p in probs if not s["count"]}
    open_ = _opened(stats, probs)
    while open_:
        row, counted = counted or _counted(values, open_), None
        wide, again = {}, {}
        for key, item in open_.items():
            below, at_lo, between, at_hi, listed = row[key]
            ends = [(below, at_lo, item["lo"]), (below + at_lo + between, at_hi, item["hi"])]
            if not below <= item["k"][0] <= item["k"][1] < below + at_lo + between + at_hi:
                low, high = stats[key[0]]["min"], stats[key[0]]["max"]
                if not retry or (item["lo"], item["hi"]) == (low, high):
                    raise RuntimeError(f"quantile bracket of column {key[0]} misses rank {item['k']}")
                again[key] = item | {"lo": low, "hi": high, "span": stats[key[0]]["count"]}
                continue

            def at(rank, ends=ends, first=below + at_lo, listed=listed):
                for start, n, value in ends:
                    if start <= rank < start + n:
                        return value
                return None if listed is None else listed[rank - first]

            low, high = map(at, item["k"])
            if low is None or high is None:
                wide[key] = item | {"first": below + at_lo, "between": between}
            else:
                found[key] = _interpolated(low, high, item["share"])
        open_ = (_narrowed(values, wide) if wide else {}) | again
    return found


def _bracket_aggs(brackets: dict) -> list:
    """For each bracket the values below, at its lower end, strictly between, at its
    upper end; and the sorted values between where few are expected."""
    aggs = []
    for (i, _), item in brackets.items():
        v, lo, hi = F.col(f"v{i}"), F.lit(item["lo"]), F.lit(item["hi"])
        between = (v > lo) & (v < hi)
        aggs += [F.count(F.when(v < lo, 1)), F.count(F.when(v == lo, 1)), F.count(F.when(between, 1)),
                 F.count(F.when((v == hi) & (lo < hi), 1))]
        if item["span"] <= GATHER:
            aggs.append(F.sort_array(F.collect_list(F.when(between, v))))
        else:
            aggs.append(F.lit(None).cast("array<double>"))
    return [a.alias(f"b{j}") for j, a in enumerate(aggs)]


def _counted(values: DataFrame, brackets: dict) -> dict:
    row = values.agg(*_bracket_aggs(brackets)).first()
    return {key: row[5 * n:5 * n + 5] for n, key in enumerate(brackets)}


def first_pass(values: DataFrame, stats: list[dict], probs: list[float]) -> tuple[list[dict], dict]:
    """Simple statistics of every column and the counts of the given brackets, in one aggregate."""
    brackets = _opened(stats, probs)
    simple = [x for i in range(len(stats)) for x in _simple(F.col(f"v{i}"))]
    row = values.agg(*[a.alias(f"a{j}") for j, a in enumerate(simple)], *_bracket_aggs(brackets)).first()
    rest = row[len(simple):]
    return ([dict(zip(("count", "mean", "std", "min", "max"), row[5 * i:5 * i + 5])) for i in range(len(stats))],
            {key: rest[5 * n:5 * n + 5] for n, key in enumerate(brackets)})


def _simple(v) -> list:
    return [F.count(v), F.avg(v), F.stddev_samp(v), F.min(v), F.max(v)]


def _narrowed(values: DataFrame, brackets: dict) -> dict:
    """New ends for each bracket, order statistics of the values strictly between the old ones."""
    aggs = []
    for (i, _), item in brackets.items():
        v = F.col(f"v{i}")
        inside = F.when((v > F.lit(item["lo"])) & (v < F.lit(item["hi"])), v)
        n, margin = item["between"], 2.0 / ACCURACY
        ranks = [max(k - item["first"], 0) / n for k in item["k"]]
        ends = [max(0.0, ranks[0] - margin - 1 / n), min(1.0, ranks[1] + margin + 2 / n)]
        aggs += [F.percentile_approx(inside, ends, ACCURACY), F.min(inside), F.max(inside), F.lit(ends[0] <= 0), F.lit(ends[1] >= 1)]
        item["span"] = (ends[1] - ends[0] + margin) * n
    row = values.agg(*[a.alias(f"a{j}") for j, a in enumerate(aggs)]).first()
    out = {}
    for j, (key, item) in enumerate(brackets.items()):
        (lo, hi), least, most, from_least, to_most = row[5 * j:5 * j + 5]
        below, above = item["k"][0] < item["first"], item["k"][1] >= item["first"] + item["between"]
        out[key] = item | {"lo": item["lo"] if below else least if from_least else lo, "hi": item["hi"] if above else most if to_most else hi}
    return out


def _quantile_name(p: float) -> str:
    return f"q{int(round(p * 100))}"


def _statistics(values: DataFrame, n: int, probs: list[float]) -> list[dict]:
    """Simple statistics and first brackets of every column, one aggregate."""
    margin = 2.0 / ACCURACY
    ends = [max(0.0, p - margin) for p in probs] + [min(1.0, p + margin) for p in probs]
    aggs = []
    for i in range(n):
        v = F.col(f"v{i}")
        aggs += [*_simple(v), F.percentile_approx(v, ends + probs, ACCURACY)]
    row = values.agg(*[a.alias(f"a{j}") for j, a in enumerate(aggs)]).first()
    out = []
    for i in range(n):
        count, mean, std, low, high, near = row[6 * i:6 * i + 6]
        m = len(probs)
        near = near or [None] * (3 * m)
        # an end at 0 or 1 is the column's own end
        bracket = {p: (low if ends[j] <= 0 else near[j], high if ends[m + j] >= 1 else near[m + j]) for j, p in enumerate(probs)}
        if count <= GATHER:
            bracket = dict.fromkeys(probs, (low, high))
        out.append({"count": count, "mean": mean, "std": std, "min": low, "max": high, "near": bracket,
                    "span": count if count <= GATHER else 3 * margin * count + 2, "approx": dict(zip(probs, near[2 * m:]))})
    return out


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    """One row per column, ``q<pp>`` = exact linear-interpolated quantile."""
    values = values_of(df, cols)
    got = order_statistics(values, _statistics(values, len(cols), probs), probs)
    rows = [(c, *[got[i, p] for p in probs]) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "column string, " + ", ".join(f"{_quantile_name(p)} double" for p in probs))


def profile(df: DataFrame, cols: list[str] | None = None, quartiles: bool = False,
            digits: int | None = None, exact: bool = True) -> DataFrame:
    """P7 (``quartiles=False``) / P8: one row per numeric column. Runs its
    aggregates at once; the result is one small row per column. ``digits``
    rounds mean, std and quantiles (only if asked).

    ``exact=False`` reports ``percentile_approx`` (rank error <= n/10,000)
    from the first aggregate instead: one pass."""
    cols = numeric_columns(df) if cols is None else cols
    probs = probabilities(quartiles)
    values = values_of(df, cols)
    stats = _statistics(values, len(cols), probs) if cols else []
    got = (order_statistics(values, stats, probs) if exact
           else {(i, p): s["approx"][p] for i, s in enumerate(stats) for p in probs})
    return report(df.sparkSession, cols, stats, got, quartiles, digits)


def probabilities(quartiles: bool) -> list[float]:
    return [0.25, 0.5, 0.75] if quartiles else [0.5]


def report(spark, cols: list[str], stats: list[dict], quantiles: dict, quartiles: bool, digits: int | None) -> DataFrame:
    """One row per column of its statistics and quantiles."""
    names = ["q25", "q50", "median", "q75"] if quartiles else ["median"]
    schema = ", ".join(["column string, count long, mean double, std double, min double",
                        *[f"{n} double" for n in names], "max double"])
    rows = []
    for i, (c, s) in enumerate(zip(cols, stats)):
        q = [quantiles[i, p] for p in ([0.25, 0.5, 0.5, 0.75] if quartiles else [0.5])]
        rows.append((c, s["count"], s["mean"], s["std"], s["min"], *q, s["max"]))
    out = spark.createDataFrame(rows, schema)
    if digits is not None:
        out = out.select(*[F.round(c, digits).alias(c) if c in ("mean", "std", *names) else F.col(c) for c in out.columns])
    return out


def profile_extended(df: DataFrame, cols: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """Quartiles for the chosen numeric columns; by default the first
    three, as the reference's selection box starts."""
    return profile(df, numeric_columns(df)[:3] if cols is None else cols, quartiles=True, digits=digits)


def row_count(df: DataFrame) -> DataFrame:
    """Number of exported rows."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))
