"""Incremental survey sums (A5, A8): stored partial sums and signed changes.

A *partial* is one row per county and question: how many responses there are,
how many hold a value, the sum of the finite values, and how many are plus
infinity, minus infinity and no number.  Every field is a sum, so partials of
different batches add up, and those of withdrawn responses subtract: the sums
after a change are the stored ones plus the change, without the base facts.
Values that no sum can give back (infinities) are counted instead of added, so a
withdrawal undoes them too.

``PartialStore`` keeps a base and the changes as commits of a log
(``versions.CommitLog``): a change is published whole or not at all, and a batch
that is delivered twice counts once.  Reading adds the pieces of the newest
state up in one shuffle of partials; ``compact`` writes them as a new base.

Sums of whole numbers equal those of a new computation; sums of fractions may
differ from it in the last bits, as any two orders of addition do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionpanel.functions.keys import in_list, quote, select_sql, zero_fill_sql
from regionpanel.operators.dimension import county_dimension, keep_keys, sized_spine
from regionpanel.operators.wide import pivot_by_key
from regionpanel.plans.spec import Scope
from regionpanel.sources.schema import META
from regionpanel.sources.tables import Tables
from regionpanel.sources.versions import CommitLog

KEYS = ("county_key", "question_id")
FIELDS = ("n", "n_values", "total", "n_pos", "n_neg", "n_nan")
COLUMNS = (*KEYS, *FIELDS)


def partials(responses: DataFrame, sign: int = 1) -> DataFrame:
    """Partials of canonical responses (county_key, question_id, value); ``sign`` -1 withdraws them."""
    v, one = F.col("value"), F.lit(sign).cast("long")
    count = lambda cond: F.sum(F.when(cond, one).otherwise(F.lit(0).cast("long")))
    nan = F.coalesce(F.isnan(v), F.lit(False))
    infinite = (F.abs(v) == float("inf")) & ~nan
    finite = v.isNotNull() & ~nan & ~infinite
    return responses.groupBy(*KEYS).agg(
        F.sum(one).alias("n"), count(v.isNotNull()).alias("n_values"),
        F.coalesce(F.sum(F.when(finite, v * sign)), F.lit(0.0)).alias("total"),
        count(infinite & (v > 0)).alias("n_pos"), count(infinite & (v < 0)).alias("n_neg"), count(nan).alias("n_nan"))


def add_up(parts: list[DataFrame]) -> DataFrame:
    """Partials of all parts together. A cell without responses goes; one with
    fewer than none means that something was withdrawn that was never there."""
    every = reduce(DataFrame.unionByName, [p.select(*COLUMNS) for p in parts])
    summed = every.groupBy(*KEYS).agg(*[F.sum(f).alias(f) for f in FIELDS])
    sound = F.least("n", "n_values", "n_pos", "n_neg", "n_nan") >= 0
    checked = F.when(sound, F.col("n") > 0).otherwise(
        F.raise_error(F.lit("withdrawn responses that were never added")).cast("boolean"))
    return summed.where(checked)


def cell_sum():
    """The double that summing a cell's values gives, NULL without values."""
    return (F.when(F.col("n_values") == 0, None)
            .when((F.col("n_nan") > 0) | ((F.col("n_pos") > 0) & (F.col("n_neg") > 0)), F.lit(float("nan")))
            .when(F.col("n_pos") > 0, F.lit(float("inf"))).when(F.col("n_neg") > 0, F.lit(float("-inf"))).otherwise(F.col("total")))


class PartialStore(CommitLog):
    """Base and changes of the partials below one folder."""

    def _publish(self, frame: DataFrame, kind: str, name: str, based_on: int | None, parts: list[str]) -> int:
        folder = self.fresh_folder()
        frame.select(*COLUMNS).write.parquet(f"{self.root}/{folder}")
        newest = self.latest()
        batches = newest.about["batches"] if newest else []
        about = {"kind": kind, "parts": [*parts, folder], "batches": batches + ([name] if name else [])}
        return self.publish(folder, about, based_on).number

    def create(self, responses: DataFrame) -> int:
        if self.latest() is not None:
            raise ValueError(f"{self.root} has a base already")
        return self._publish(partials(responses), "base", "", 0, [])

    def change(self, batch: str, added: DataFrame | None = None, withdrawn: DataFrame | None = None) -> int:
        """Publish a batch of added and withdrawn responses; a batch already there changes nothing."""
        newest = self.latest()
        if newest is None:
            raise ValueError(f"{self.root} has no base")
        if batch in newest.about["batches"]:
            return newest.number
        parts = [partials(df, sign) for df, sign in ((added, 1), (withdrawn, -1)) if df is not None]
        if not parts:
            raise ValueError("a change adds or withdraws something")
        frame = reduce(DataFrame.unionByName, parts)
        return self._publish(frame, "change", batch, newest.number, newest.about["parts"])

    def read(self, version: int | None = None) -> DataFrame:
        c = self.latest() if version is None else self.commit_of(version)
        if c is None:
            raise ValueError(f"{self.root} holds no partials" if version is None else f"{self.root} holds no state {version}")
        schema = ("county_key string, question_id long, n long, n_values long, total double, n_pos long, n_neg long, n_nan long")
        parts = [self.spark.read.schema(schema).parquet(f"{self.root}/{f}") for f in c.about["parts"]]
        return add_up(parts) if len(parts) > 1 else parts[0]

    def compact(self) -> int:
        """The newest state as one base; earlier states stay readable until they expire."""
        newest = self.latest()
        if newest is None or len(newest.about["parts"]) == 1:
            return newest.number if newest else 0
        return self._publish(self.read(newest.number), "base", "", newest.number, [])

    def expire(self, *a, **k):
        """Changes name the folders of the states before them: compact, then remove what no kept state names."""
        raise NotImplementedError("a state's parts lie in several commits; keep the log or start a new store from read()")


def category_partials(cells: DataFrame, tables: Tables, categories=None) -> DataFrame:
    """County x category partials from county x question ones (questions no dictionary knows drop out)."""
    asked = tables.questions if categories is None else tables.questions.where(in_list("category", categories))
    return (cells.join(asked.select("question_id", "category"), "question_id").groupBy("county_key", "category")
            .agg(*[F.sum(f).alias(f) for f in FIELDS]))


def _scoped(cells: DataFrame, scope: Scope) -> DataFrame:
    return keep_keys(cells, "county_key", scope.county_keys()) if scope.kind == "county" else cells


def score_long(tables: Tables, cells: DataFrame, scope: Scope, categories: list[str]) -> DataFrame:
    """A5/A6 from partials: as ``scores.score_long``, without the responses."""
    sums = category_partials(_scoped(cells, scope), tables, categories)
    return (sized_spine(tables, scope).join(sums, "county_key", "inner")
            .select(*META, "category", cell_sum().alias("county_category_score")))


def score_wide(tables: Tables, cells: DataFrame, scope: Scope, categories: list[str], suffix: str = "_Sum") -> DataFrame:
    """A7 from partials."""
    sums = category_partials(_scoped(cells, scope), tables, categories).select("county_key", "category", cell_sum().alias("value"))
    wide = pivot_by_key(sums, "category", "value", {c: c + suffix for c in categories}, "sum")
    block = select_sql(wide, ["county_key", *[zero_fill_sql(quote(c + suffix), c + suffix) for c in categories]])
    return select_sql(sized_spine(tables, scope).join(block, "county_key", "inner"), [*META, *[quote(c + suffix) for c in categories]])


def question_long_dense(tables: Tables, cells: DataFrame, scope: Scope, labels: dict[int, str]) -> DataFrame:
    """A8/A9 from partials: every county of the scope, 0.0 without a response."""
    asked = _scoped(cells, scope).where(in_list("question_id", labels)).select("county_key", "question_id", cell_sum().alias("value"))
    wide = pivot_by_key(asked, "question_id", "value", {q: f"q{q}" for q in labels}, "sum")
    joined = county_dimension(tables, scope).join(wide, "county_key", "left")
    one = lambda q, label: F.struct(F.lit(q).cast("long").alias("question_id"), F.lit(label).alias("question_name"),
                                    F.coalesce(f"q{q}", F.lit(0.0)).alias("value_sum"))
    return joined.select(*META, F.inline(F.array(*[one(q, label) for q, label in labels.items()])))
