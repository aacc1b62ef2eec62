"""Stored results that answer narrower requests.

``ResultStore`` keeps finished exports, each under the snapshot version and the
request it was made for. A later request on the same version is *contained* in
a stored one if it asks for no more: a scope within the stored scope, variables,
categories, questions and state columns among the stored ones, any band where
the stored result has all. It is then answered by a filter and a projection of
the stored rows; no fact table is read.

Which counties a request returns depends on what it asks (a county without a
response in a chosen category is no row of a pure category request), so a stored
row also says which of the stored variables have a fact for it and which summed
categories a response: two small arrays, no longer than the request.

Results are commits of a log (``versions.CommitLog``): written whole, published
in one step, expired like snapshots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionpanel.functions.keys import COUNTY_WIDTH, in_list, pad_code, qcol
from regionpanel.operators import scores as SC
from regionpanel.operators.dimension import scoped_facts, scoped_states
from regionpanel.operators.wide import variable_label
from regionpanel.plans.export import census_variables_of, export, export_frame, finish
from regionpanel.plans.spec import ExportSpec, Scope
from regionpanel.sources.schema import META
from regionpanel.sources.tables import Tables
from regionpanel.sources.versions import Commit, CommitLog

VARS, CATS = "_variables_present", "_categories_present"


def scope_within(inner: Scope, outer: Scope) -> bool:
    """Every county of ``inner`` is one of ``outer``, as far as the requests say."""
    if outer.all_states:
        return True
    if inner.kind != outer.kind or inner.all_states:
        return False
    keys = (lambda s: set(s.abbrev_keys())) if inner.kind == "state" else (lambda s: set(s.county_keys()))
    return keys(inner) <= keys(outer)


def _asked(tables: Tables, spec: ExportSpec):
    """(variables, details, sums) of a request: ids, ordered (category, question ids), categories."""
    variables = census_variables_of(tables, spec)
    details, sums, seen = [], [], set()
    for c in spec.categories:
        if c.category in seen:
            continue
        seen.add(c.category)
        if c.sum_scores:
            sums.append(c.category)
        else:
            labels = SC.question_labels(tables, SC.question_ids(tables, c.selected_questions))
            if labels:
                details.append((c.category, labels))
    return variables, details, sums


def contains(tables: Tables, stored: ExportSpec, asked: ExportSpec) -> bool:
    """Whether a stored result of ``stored`` holds all that ``asked`` asks for."""
    if not scope_within(asked.scope, stored.scope) or stored.band not in ("All", asked.band) or stored.sum_suffix != asked.sum_suffix:
        return False
    (v, d, s), (v0, d0, s0) = _asked(tables, asked), _asked(tables, stored)
    if not v and not d and not s:
        return False  # a state frame alone has no county rows
    whole = {c: list(labels.values()) for c, labels in d0}
    return (set(v) <= set(v0) and set(s) <= set(s0) and all(whole.get(c) == list(labels.values()) for c, labels in d)
            and set(asked.state_variables) <= set(stored.state_variables) and (asked.band == "All" or {1, 43} <= set(v0)))


def _presence(tables: Tables, spec: ExportSpec) -> DataFrame:
    """county_id with the variables and summed categories that have a row for it."""
    variables, _, sums = _asked(tables, spec)
    none = lambda kind: F.array().cast(f"array<{kind}>")
    facts = scoped_facts(tables.census_facts, tables, spec.scope).where(in_list("variable_id", variables))
    some = facts.select("county_key", F.col("variable_id").alias("v"), F.lit(None).cast("string").alias("c"))
    if sums:
        r = SC.with_category(tables, scoped_facts(tables.responses, tables, spec.scope), in_list("category", sums))
        some = some.unionByName(r.select("county_key", F.lit(None).cast("int").alias("v"), F.col("category").alias("c")))
    return some.groupBy("county_key").agg(F.coalesce(F.collect_set("v"), none("int")).alias(VARS),
                                          F.coalesce(F.collect_set("c"), none("string")).alias(CATS)) \
        .select(pad_code("county_key", COUNTY_WIDTH).alias("county_id"), VARS, CATS)


class ResultStore(CommitLog):
    """Stored exports below one folder."""

    def store(self, tables: Tables, version: int, spec: ExportSpec) -> Commit | None:
        """Compute the request without its band and keep it for (version, request)."""
        if not any(_asked(tables, spec)):
            return None
        whole = ExportSpec(spec.scope, spec.census_variables, spec.state_variables, spec.categories, "All", spec.mandatory_variables, spec.sum_suffix)
        rows = export_frame(tables, whole).join(_presence(tables, whole), "county_id", "left")
        folder = self.fresh_folder()
        rows.write.parquet(f"{self.root}/{folder}")
        return self.publish(folder, {"version": version, "request": whole.to_json(), "columns": len(rows.columns)})

    def find(self, tables: Tables, version: int, spec: ExportSpec) -> Commit | None:
        """The stored result with the fewest columns that contains the request."""
        fits = [c for c in self.commits() if c.about.get("version") == version
                and contains(tables, ExportSpec.from_json(c.about["request"]), spec)]
        return min(fits, key=lambda c: (c.about["columns"], -c.number)) if fits else None

    def answer(self, tables: Tables, version: int, spec: ExportSpec, labelled: bool = False, ordered: bool = True) -> DataFrame | None:
        """The request's export from a stored result, or None. Reads the stored
        rows and, for the names asked, the dictionaries."""
        found = self.find(tables, version, spec)
        if found is None:
            return None
        df = self.spark.read.parquet(self.path_of(found))
        variables, details, sums = _asked(tables, spec)
        scope, stored = spec.scope, ExportSpec.from_json(found.about["request"]).scope
        if scope.kind == "county":
            df = df.where(in_list("county_id", [k.zfill(COUNTY_WIDTH) for k in scope.county_keys()]))
        elif not scope.all_states and scope != stored:
            df = df.where(in_list("state_id", [r.state_id for r in scoped_states(tables, scope).select("state_id").collect()]))
        overlap = lambda column, values: F.coalesce(F.arrays_overlap(column, F.array(*[F.lit(v) for v in values])), F.lit(False)) \
            if values else F.lit(False)
        in_sums = overlap(CATS, sums)
        if not details:
            df = df.where(overlap(VARS, list(variables)) | in_sums)
        out = {m: F.col(m) for m in META}
        for vid, name in variables.items():
            out.setdefault(variable_label(vid, name), qcol(variable_label(vid, name)))
        for category, labels in details:
            for c in [*labels.values(), category + spec.sum_suffix]:
                out.setdefault(c, qcol(c))
        for c in sums:
            out.setdefault(c + spec.sum_suffix, F.when(in_sums, qcol(c + spec.sum_suffix)))
        for c in spec.state_variables:
            out.setdefault(c, qcol(c))
        frame = df.select(*[x.alias(c) for c, x in out.items()])
        return finish(frame, spec, tables.header_dictionary if labelled else None, order=ordered)

    def export(self, tables: Tables, version: int, spec: ExportSpec, keep: bool = True, **options) -> DataFrame:
        """The export of a request: from a stored result where one contains it,
        else computed and (``keep``) stored for later ones."""
        got = self.answer(tables, version, spec, **options)
        if got is None and keep and self.store(tables, version, spec) is not None:
            got = self.answer(tables, version, spec, **options)
        return export(tables, spec, **options) if got is None else got
