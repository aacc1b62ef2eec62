"""

``entry(spark)`` runs the flagship export on /root/testdata/sf0.001;
``oracle_sql()`` the DuckDB SQL each is checked against (``oracle_sql.py``).

Every query derives the star schema from the given tables (FIXTURES.md §2)
and runs over all of it; request parameters come from
``regionpanel.plans.requests``.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from regionpanel.functions import keys as K  # noqa: E402
from regionpanel.operators import bands, headers, lookups  # noqa: E402
from regionpanel.operators import profile as P  # noqa: E402
from regionpanel.operators import scores as SC  # noqa: E402
from regionpanel.operators import wide as W  # noqa: E402
from regionpanel.operators.assemble import attach_state, merge_outer, state_frame  # noqa: E402
from regionpanel.operators.dimension import county_dimension  # noqa: E402
from regionpanel.plans import requests as R  # noqa: E402
from regionpanel.plans.export import export  # noqa: E402
from regionpanel.sources.sinks import write_frame  # noqa: E402
from regionpanel.plans.spec import Scope  # noqa: E402
from regionpanel.session import checkpoint_dir, configure, materialise, release  # noqa: E402
from regionpanel.sources.fixture import fixture_tables, stored_relations  # noqa: E402
from regionpanel.sources.schema import META  # noqa: E402
from regionpanel.sources.tables import Tables  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"


_LOADED: dict = {}


def _tables(spark: SparkSession, sf_dir: str):
    """The star schema of ``sf_dir``, built once per session (lazy plans:
    every query still reads the tables when it runs)."""
    key = (id(spark), spark.conf.get("spark.app.id", ""), sf_dir)
    if key not in _LOADED:
        configure(spark)
        _LOADED[key] = fixture_tables(spark, sf_dir)
    return _LOADED[key]


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the full state-scope export (census, scores, state columns)."""
    return export(_tables(spark, SMOKE_DIR), R.state_full())


# ------------------------------------------------------------------ queries

def q_snapshot_row_counts(spark, d):
    stored = stored_relations(spark, d)
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("relation"), "n_rows")
             for name, df in stored.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def q_column_scan(spark, d):
    return lookups.column_values(_tables(spark, d).questions, "category")


def q_variable_names(spark, d):
    return lookups.fact_variable_names(_tables(spark, d))


def q_question_catalogue(spark, d):
    return lookups.column_values(_tables(spark, d).questions, ["question", "category"])


def q_state_variable_list(spark, d):
    return lookups.state_variable_list(_tables(spark, d))


def q_split_trim_codes(spark, d):
    counties = stored_relations(spark, d)["counties"]
    text = F.concat(F.lit(" "), F.col("county_id"), F.lit(" ,"), K.pad_code("county_id", 5), F.lit(",, "))
    codes = counties.select(F.explode(K.split_codes(text)).alias("code"))
    return codes.select("code", K.county_request_key("code").alias("county_key"))


def q_code_normalise(spark, d):
    counties = stored_relations(spark, d)["counties"]
    return counties.select(
        F.col("county_id").alias("county_id_stored"), F.col("state_id").alias("state_id_stored"),
        K.strip_code("county_id").alias("county_key"), K.strip_code("state_id").alias("state_key"),
        K.pad_code(K.strip_code("county_id"), K.COUNTY_WIDTH).alias("county_id"),
        K.pad_code(K.strip_code("state_id"), K.STATE_WIDTH).alias("state_id"),
    )


def q_code_digits_only(spark, d):
    counties = stored_relations(spark, d)["counties"]
    return counties.select(
        "name", K.digits_only("name").alias("digits"),
        K.county_request_key("name").alias("county_key"),
        K.pad_code(K.county_request_key("name"), K.COUNTY_WIDTH).alias("county_id"),
    )


def q_label_normalise(spark, d):
    q = _tables(spark, d).questions
    labels = (q.select(F.concat(F.col("question_id").cast("string"), F.lit(": "), "question").alias("label"))
              .unionByName(q.select(F.concat("category", F.lit("_Sum")).alias("label")))
              .unionByName(q.select(F.concat(F.lit(" "), F.col("question_id").cast("string"), F.lit(" : "),
                                             "question", F.lit(" ")).alias("label"))))
    return labels.select("label", K.normalise_label("label").alias("normalised"))


def q_state_lookup(spark, d):
    return lookups.state_ids(_tables(spark, d), R.STATE_ABBREVS)


def q_states_of_counties(spark, d):
    return lookups.states_of_counties(_tables(spark, d), R.COUNTY_CODES)


def q_county_names(spark, d):
    return lookups.county_names(_tables(spark, d), R.COUNTY_CODES)


def q_question_lookup(spark, d):
    t = _tables(spark, d)
    request = (t.questions.where(F.col("category") == R.DETAIL_CATEGORY)
               .select(F.upper(F.concat(F.lit("  "), "question", F.lit(" "))).alias("name")))
    return lookups.question_lookup(t, request)


def q_census_variable_lookup(spark, d):
    t = _tables(spark, d)
    return lookups.census_variable_lookup(t, t.header_dictionary.select("name"))


def q_mandatory_variables(spark, d):
    t = _tables(spark, d)
    return lookups.mandatory_variables(t, t.questions.select(F.col("category").alias("name")))


def q_catalogue_search(spark, d):
    return lookups.catalogue_search(_tables(spark, d).questions, "question", R.SEARCH_TEXT)


def q_question_categories(spark, d):
    return lookups.question_categories(_tables(spark, d))


def q_questions_in_category(spark, d):
    return lookups.questions_in_category(_tables(spark, d), R.DETAIL_CATEGORY)


def q_state_wide_select(spark, d):
    return W.state_wide_select(_tables(spark, d), None, list(reversed(R.STATE_COLUMNS)))


def q_county_dimension(spark, d):
    return county_dimension(_tables(spark, d), R.ALL_STATES).select(*META)


def q_merge_outer(spark, d):
    t = _tables(spark, d)
    left = W.census_wide(t, R.ALL_STATES, W.resolve_census_variables(t, [11]))
    right = SC.score_wide(t, R.ALL_STATES, ["PROMO"])
    return merge_outer(left, right)


def q_attach_state_vars(spark, d):
    t = _tables(spark, d)
    cw = W.census_wide(t, R.ALL_STATES, W.resolve_census_variables(t, R.DENSITY_VARIABLES))
    return attach_state(cw, state_frame(t, R.ALL_STATES, list(R.STATE_COLUMNS)))


def q_dup_ids_score(spark, d):
    return SC.score_wide(_tables(spark, d), Scope.counties(R.DUP_COUNTY_CODES), ["PROMO", "SMALL"])


def _vars(t, ids):
    return W.resolve_census_variables(t, ids)


def q_census_long_state(spark, d):
    t = _tables(spark, d)
    return W.census_long(t, R.ALL_STATES, _vars(t, R.ALL_VARIABLES))


def q_census_long_county(spark, d):
    t = _tables(spark, d)
    return W.census_long(t, Scope.counties(R.COUNTY_CODES), _vars(t, R.ALL_VARIABLES))


def q_census_wide_state(spark, d):
    t = _tables(spark, d)
    return W.census_wide(t, R.ALL_STATES, _vars(t, R.BASIC_VARIABLES))


def q_census_wide_county(spark, d):
    t = _tables(spark, d)
    return W.census_wide(t, Scope.counties(R.COUNTY_CODES), _vars(t, R.ALL_VARIABLES))


def q_pivot_duplicate_check(spark, d):
    return W.duplicate_keys(_tables(spark, d).responses, ["county_key", "question_id"])


def q_empty_selection(spark, d):
    t = _tables(spark, d)
    return W.census_wide(t, Scope.states(R.UNKNOWN_STATES), _vars(t, R.DENSITY_VARIABLES))


def q_score_long_state(spark, d):
    return SC.score_long(_tables(spark, d), R.ALL_STATES, list(R.SUM_CATEGORIES))


def q_score_long_county(spark, d):
    return SC.score_long(_tables(spark, d), Scope.counties(R.COUNTY_CODES), list(R.SUM_CATEGORIES))


def q_score_wide_state(spark, d):
    return SC.score_wide(_tables(spark, d), R.ALL_STATES, list(R.SUM_CATEGORIES))


def q_score_wide_county(spark, d):
    return SC.score_wide(_tables(spark, d), Scope.counties(R.COUNTY_CODES), list(R.SUM_CATEGORIES))


def _matrix_labels(t):
    return SC.question_labels(t, SC.question_ids(t, R.MATRIX_QUESTIONS))


def q_question_long_dense(spark, d):
    t = _tables(spark, d)
    return SC.question_long_dense(t, R.ALL_STATES, _matrix_labels(t))


def q_question_long_dense_county(spark, d):
    t = _tables(spark, d)
    return SC.question_long_dense(t, Scope.counties(R.COUNTY_CODES), _matrix_labels(t))


def _by_id(t, df, qids=R.DETAIL_QUESTIONS):
    """Question columns named ``q<id>``: their texts are data, SQL cannot name
    them ahead. ``question_matrix_names`` compares the texts themselves."""
    ids = {label: f"q{q}" for q, label in SC.question_labels(t, SC.question_ids(t, qids)).items()}
    return df.select(*[K.qcol(c).alias(ids.get(c, c)) for c in df.columns])


def _matrix(spark, d, scope, qids):
    t = _tables(spark, d)
    return _by_id(t, SC.question_matrix(t, scope, SC.question_labels(t, SC.question_ids(t, qids))), qids)


def q_question_matrix_state(spark, d):
    return _matrix(spark, d, R.ALL_STATES, R.MATRIX_QUESTIONS)


def q_question_matrix_county(spark, d):
    return _matrix(spark, d, Scope.counties(R.COUNTY_CODES), R.MATRIX_QUESTIONS)


def q_question_matrix_64(spark, d):
    return _matrix(spark, d, R.ALL_STATES, tuple(range(1, 65)))


def q_question_matrix_65(spark, d):
    return _matrix(spark, d, R.ALL_STATES, tuple(range(1, 66)))


def q_question_matrix_names(spark, d):
    """The matrix under its question texts, column by column."""
    t = _tables(spark, d)
    wide = SC.question_matrix(t, R.ALL_STATES, _matrix_labels(t))
    return wide.unpivot(["county_id"], [K.qcol(c) for c in wide.columns if c not in META], "column", "value")


def q_empty_question_matrix(spark, d):
    return SC.question_matrix(_tables(spark, d), R.ALL_STATES, {})


def q_score_blocks_state(spark, d):
    t = _tables(spark, d)
    return _by_id(t, SC.score_blocks(t, R.ALL_STATES, R.full_categories()))


def q_question_matrix_category(spark, d):
    """Every question of a category: their number grows with the data, so the
    result stays long (a wide frame is for a named list of questions)."""
    t = _tables(spark, d)
    return SC.question_sums(t, R.ALL_STATES, R.DETAIL_CATEGORY)


def q_score_blocks_county(spark, d):
    t = _tables(spark, d)
    return _by_id(t, SC.score_blocks(t, Scope.counties(R.COUNTY_CODES), R.full_categories()))


def q_score_fraction(spark, d):
    """Survey values with more than two decimals: sums of doubles, compared to six places."""
    stored = stored_relations(spark, d)
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_extendedprice", "l_discount")
    share = (F.col("l_extendedprice").cast("double") * F.col("l_discount").cast("double") / 997).cast("string")
    stored["responses"] = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").cast("string").alias("county_id"), F.col("l_partkey").cast("long").alias("question_id"), share.alias("value"))
    out = SC.score_wide(Tables.from_stored(**stored), R.ALL_STATES, ["PROMO", "SMALL"])
    return out.select(*META, *[F.round(c, 6).alias(c) for c in ("PROMO_Sum", "SMALL_Sum")])


def q_wide_code_merge(spark, d):
    """County codes of seven digits, alike in their first five: ids stay whole and rows apart."""
    stored = stored_relations(spark, d)
    longer = F.concat(F.lit("9990"), F.lpad(F.col("county_id"), 9, "0"))
    for name in ("counties", "census_facts", "responses"):
        stored[name] = stored[name].withColumn("county_id", longer)
    t = Tables.from_stored(**stored)
    left = W.census_wide(t, R.ALL_STATES, W.resolve_census_variables(t, [11]))
    return merge_outer(left, SC.score_wide(t, R.ALL_STATES, ["PROMO"]))


def q_census_duplicate_check(spark, d):
    """Census facts stored twice (every fact of variable 12 once more): the cells the pivot refuses."""
    stored = stored_relations(spark, d)
    facts = stored["census_facts"]
    stored["census_facts"] = facts.unionByName(facts.where(F.col("variable_id") == 12))
    return W.pivot_duplicates(Tables.from_stored(**stored))


_STATES = Scope.states(R.STATE_ABBREVS)
_MORE_STATES = Scope.states("N00, n03,N07")


def q_census_wide_states(spark, d):
    t = _tables(spark, d)
    return W.census_wide(t, _STATES, _vars(t, R.BASIC_VARIABLES))


def q_census_long_states(spark, d):
    t = _tables(spark, d)
    return W.census_long(t, _MORE_STATES, _vars(t, R.ALL_VARIABLES))


def q_score_wide_states(spark, d):
    return SC.score_wide(_tables(spark, d), _STATES, list(R.SUM_CATEGORIES))


def q_export_states(spark, d):
    t = _tables(spark, d)
    return _by_id(t, export(t, R.state_full(_MORE_STATES)))


def q_export_states_snapshot(spark, d):
    t = _snapshot(spark, d)
    return _by_id(t, export(t, R.state_full(_MORE_STATES)))


def _density_base(spark, d):
    t = _tables(spark, d)
    return W.census_wide(t, R.ALL_STATES, _vars(t, R.DENSITY_VARIABLES))


def q_density(spark, d):
    return bands.with_density(_density_base(spark, d))


def q_density_band(spark, d):
    return bands.with_density(_density_base(spark, d), with_band=True)


def q_density_rural(spark, d):
    return bands.filter_by_band(_density_base(spark, d), "Rural")


def q_density_suburban(spark, d):
    return bands.filter_by_band(_density_base(spark, d), "Suburban")


def q_density_urban(spark, d):
    return bands.filter_by_band(_density_base(spark, d), "Urban")


def q_header_lookup(spark, d):
    return headers.header_lookup(_tables(spark, d).header_dictionary)


def q_header_apply(spark, d):
    t = _tables(spark, d)
    return headers.column_dictionary(_by_id(t, export(t, R.state_full())), t.header_dictionary)


def q_header_csv(spark, d):
    """The header dictionary written as CSV beside the data, read back by its reader and looked up."""
    import uuid

    path = f"{checkpoint_dir(spark)}/header-{uuid.uuid4().hex}"
    (_tables(spark, d).header_dictionary.orderBy("ordinal", "name").coalesce(1)
     .select("name", "header", F.lit("x").alias("note")).write.option("header", True).csv(path))
    return headers.header_lookup(headers.read_header_dictionary(spark, path))


def q_category_labels(spark, d):
    """Categories of the questions, the known ones among them by part size."""
    t = _tables(spark, d)
    known = F.array(*[F.lit(c) for c in ("Reg", "Voting", "Abuses", "pollworkers", "Registration", "dropboxes", "Vote Centers",
                                        "Ease of Registration")])
    mapped = t.questions.select(F.explode(F.array("category", F.element_at(known, (F.col("question_id") % 8 + 1).cast("int"))))
                                .alias("category"))
    return headers.category_labels(mapped.distinct())


def _checkpointed_export(spark, d):
    t = _tables(spark, d)
    return materialise(_by_id(t, export(t, R.state_full(), ordered=False)), "export")


def q_export_row_count(spark, d):
    return P.row_count(export(_tables(spark, d), R.state_full(), ordered=False))


def q_profile_numeric(spark, d):
    return _profiled(spark, d, P.profile)


def q_profile_extended(spark, d):
    return _profiled(spark, d, lambda df, digits: P.profile(df, quartiles=True, digits=digits))


def q_profile_default3(spark, d):
    return _profiled(spark, d, P.profile_extended)


def _profiled(spark, d, of):
    """Rounded to six places for the comparison only."""
    df = _checkpointed_export(spark, d)
    out = of(df, digits=6)  # runs its passes now
    release(df)
    return out


def q_export_state_scope(spark, d):
    t = _tables(spark, d)
    return _by_id(t, export(t, R.state_full()))


def q_export_state_band(spark, d):
    t = _tables(spark, d)
    return _by_id(t, export(t, R.state_full(band="Suburban")))


def q_export_state_only(spark, d):
    return export(_tables(spark, d), R.state_only())


def q_export_county_scope(spark, d):
    t = _tables(spark, d)
    return _by_id(t, export(t, R.county_full()))


def q_export_job(spark, d):
    """The whole job: data, column dictionary, request and profile written, all read back and told apart by ``part``."""
    import uuid

    from regionpanel.plans.export import read_request, run_export

    t = _tables(spark, d)
    out = f"{checkpoint_dir(spark)}/job-{uuid.uuid4().hex}"
    spec = R.state_full(Scope.states(None), band="Suburban")
    run_export(t, spec, out, fmt="csv")
    assert read_request(spark, out) == spec
    schema = export(t, spec, ordered=False).schema
    data = _by_id(t, spark.read.schema(schema).option("header", True).csv(f"{out}/data"))
    ids = {label: f"q{q}" for q, label in SC.question_labels(t, SC.question_ids(t, R.DETAIL_QUESTIONS)).items()}
    named = lambda c: F.coalesce(*[F.when(F.col(c) == k, v) for k, v in ids.items()], F.col(c))
    cells = data.unpivot(["county_id"], [K.qcol(c) for c in data.columns if c not in META], "name", "v")
    measured = cells.select(F.lit("data").alias("part"), F.concat_ws("|", "county_id", "name").alias("name"), F.round("v", 6).alias("value"))
    columns = spark.read.parquet(f"{out}/columns").select(
        F.lit("columns").alias("part"), F.concat_ws("|", named("column"), "group").alias("name"), F.col("ordinal").cast("double").alias("value"))
    prof = spark.read.parquet(f"{out}/profile").select(
        F.lit("profile").alias("part"), named("column").alias("name"), F.round("median", 6).alias("value"))
    return measured.unionByName(columns).unionByName(prof)


_SNAPSHOTS: dict = {}


def _snapshot(spark, d):
    """The tables written once as a canonical snapshot in the checkpoint folder and loaded back."""
    import uuid

    key = (id(spark), spark.conf.get("spark.app.id", ""), d)
    if key not in _SNAPSHOTS:
        path = f"{checkpoint_dir(spark)}/snapshot-{uuid.uuid4().hex}"
        _tables(spark, d).write_snapshot(path)
        _SNAPSHOTS[key] = Tables.load(spark, path)
    return _SNAPSHOTS[key]


def q_export_snapshot_roundtrip(spark, d):
    """The production path: the tables written once as a canonical snapshot
    (facts partitioned by state, categories on responses), loaded, exported."""
    t = _snapshot(spark, d)
    return _by_id(t, export(t, R.state_full()))


def q_export_csv_roundtrip(spark, d):
    import uuid

    t = _tables(spark, d)
    df = _by_id(t, export(t, R.state_full()))
    path = f"{checkpoint_dir(spark)}/csv-roundtrip-{uuid.uuid4().hex}"
    write_frame(df, path, "csv")
    return spark.read.schema(df.schema).option("header", True).csv(path)


def _fresh(spark, name):
    import uuid

    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


_KEPT: dict = {}


def _kept(spark, d, name, make):
    """What ``make`` gives, once per session and data folder."""
    key = (id(spark), spark.conf.get("spark.app.id", ""), d, name)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def q_snapshot_versions(spark, d):
    """Two published versions (the second is the first, loaded, without responses up to 25): the first is read after the second is there."""
    from dataclasses import replace

    from regionpanel.sources.versions import SnapshotStore

    def make():
        store = SnapshotStore(spark, _fresh(spark, "versions"))
        store.publish_tables(_tables(spark, d))
        first = store.load(1)
        store.publish_tables(replace(first, responses=first.responses.where("value > 25"), _memo={}), based_on=1)
        return store

    store = _kept(spark, d, "versions", make)
    one = lambda v: SC.score_wide(store.load(v), R.ALL_STATES, list(R.SUM_CATEGORIES)).withColumn("version", F.lit(v))
    return one(1).unionByName(one(2))


def q_export_bucketed(spark, d):
    """The full export on a snapshot whose facts are bucketed by county."""
    def make():
        path = _fresh(spark, "bucketed")
        _tables(spark, d).write_snapshot(path, layout="bucketed")
        return Tables.load(spark, path)

    t = _kept(spark, d, "bucketed", make)
    return _by_id(t, export(t, R.state_full()))


def _partial_cells(spark, d):
    """Partial sums of the responses of orders before 1997, then two changes:
    the later ones added, those of returned items withdrawn."""
    from regionpanel.operators.partials import PartialStore

    def make():
        o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
        li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
        r = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(
            K.strip_code("o_custkey").alias("county_key"), F.col("l_partkey").cast("long").alias("question_id"),
            F.col("l_quantity").cast("double").alias("value"), (F.col("o_orderdate") < "1997-01-01").alias("early"), "l_returnflag")
        store = PartialStore(spark, _fresh(spark, "partials"))
        store.create(r.where("early"))
        store.change("later", added=r.where("not early"))
        store.change("returned", withdrawn=r.where("l_returnflag = 'R'"))
        return store

    return _kept(spark, d, "partials", make).read()


def q_score_incremental(spark, d):
    from regionpanel.operators import partials

    return partials.score_wide(_tables(spark, d), _partial_cells(spark, d), R.ALL_STATES, list(R.SUM_CATEGORIES))


def q_question_incremental(spark, d):
    from regionpanel.operators import partials

    t = _tables(spark, d)
    return partials.question_long_dense(t, _partial_cells(spark, d), R.ALL_STATES, _matrix_labels(t))


def q_merge_blocks(spark, d):
    """Four blocks with clashing columns and rows that only later blocks have, in one shuffle."""
    from regionpanel.operators.assemble import merge_all

    t = _tables(spark, d)
    return merge_all([W.census_wide(t, _MORE_STATES, _vars(t, [1, 11])), W.census_wide(t, R.ALL_STATES, _vars(t, [11, 12])),
                      SC.score_wide(t, R.ALL_STATES, ["PROMO"]), SC.score_wide(t, _STATES, ["SMALL", "PROMO"])])


def q_profile_states(spark, d):
    """The extended profile of three states of a written export, from its stored sketches and one pass."""
    from regionpanel.operators import sketches

    def make():
        df, path = _checkpointed_export(spark, d), _fresh(spark, "sketches")
        sketches.write_sketches(df, path)
        return df, spark.read.parquet(path)

    df, kept = _kept(spark, d, "sketches", make)
    # standard deviations of half a million carry no six exact places
    return sketches.profile_from(df, kept, ["00", "03", "07"], quartiles=True, digits=4)


def q_export_reuse(spark, d):
    """A narrower request answered from the stored result of the full one."""
    from regionpanel.plans.results import ResultStore
    from regionpanel.plans.spec import ExportSpec

    t = _tables(spark, d)

    def make():
        store = ResultStore(spark, _fresh(spark, "results"))
        store.store(t, 1, R.state_full())
        return store

    narrow = ExportSpec(_MORE_STATES, (11, 12), (R.STATE_COLUMNS[1],), (R.full_categories()[0], R.full_categories()[2]), "Suburban")
    return _by_id(t, _kept(spark, d, "results", make).answer(t, 1, narrow))


def q_measure_rejects(spark, d):
    """Facts with texts that are no numbers and without codes, told apart while they are written: observed and written counts."""
    from regionpanel.sources.quarantine import OK, load_facts

    stored = stored_relations(spark, d)
    stored["census_facts"] = stored["census_facts"].withColumn("data", F.when(
        (F.col("variable_id") == 43) & F.col("data").endswith("7"), F.concat(F.lit("about "), "data")).otherwise(F.col("data")))
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_linenumber")
    quantity = F.col("l_quantity").cast("string")
    stored["responses"] = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.when(F.col("l_linenumber") != 5, F.col("o_custkey").cast("string")).alias("county_id"), F.col("l_partkey").cast("long").alias("question_id"),
        F.when(F.col("l_returnflag") == "R", F.concat(quantity, F.lit(" units"))).otherwise(quantity).alias("value"))
    loaded, refused, counts = load_facts(stored, _fresh(spark, "facts"))
    seen = spark.createDataFrame([(r, why, n) for r, c in counts.items() for why, n in c.items() if n],
                                 "relation string, reason string, n_observed long")
    fine = [loaded[r].agg(F.lit(r).alias("relation"), F.lit(OK).alias("reason"), F.count(F.lit(1)).alias("n_written")) for r in counts]
    written = fine[0].unionByName(fine[1]).unionByName(refused.groupBy("relation", "reason").agg(F.count(F.lit(1)).alias("n_written")))
    return seen.join(written, ["relation", "reason"], "full")


def q_export_download(spark, d):
    """The download as one file, read back without its two header rows."""
    from regionpanel.sources.sinks import write_download

    t = _tables(spark, d)
    df = _by_id(t, export(t, R.state_full(), labelled=True, ordered=False))
    path = f"{_fresh(spark, 'download')}.csv"
    write_download(df, path)
    lines = spark.read.schema(", ".join(f"c{i} string" for i in range(len(df.columns)))).csv(path)
    body = lines.where("c2 not in ('identifier', 'county_id', 'Other')")
    return body.select(*[F.col(f"c{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(df.schema.fields)])


def q_header_files(spark, d):
    """A header dictionary in two files of several splits: the second file's entries win."""
    t = _tables(spark, d)
    q, first, second = t.questions, _fresh(spark, "headers"), _fresh(spark, "headers")
    (q.select(F.col("question").alias("name"), F.lit("Question").alias("header"))
     .unionByName(q.select(F.col("category").alias("name"), F.lit("Category").alias("header"))).write.option("header", True).csv(first))
    t.header_dictionary.select("name", "header").write.option("header", True).csv(second)
    return headers.header_lookup(headers.read_header_dictionary(spark, [first, second]))


def q_catalogue_search_index(spark, d):
    """Where the questions hold some texts of one to many characters, from the trigram index."""
    from regionpanel.operators import search

    def make():
        path = _fresh(spark, "trigrams")
        search.write_index(_tables(spark, d).questions, path, "question_id", "question")
        return search.read_index(spark, path)

    index = _kept(spark, d, "trigrams", make)
    out = None
    for q in R.SEARCH_TEXTS:
        one = search.search_places(index, q).select(F.lit(q).alias("query"), F.col("id").alias("question_id"), "first_place", "n_places")
        out = one if out is None else out.unionByName(one)
    return out


def q_long_list_facts(spark, d):
    """Facts of a list of counties taken as too long to broadcast: Bloom filter at the scan, then the semi join."""
    from regionpanel.operators import dimension

    t = _tables(spark, d)
    ids = spark.read.parquet(f"{d}/customer.parquet").where("c_acctbal < 0").select(K.strip_code("c_custkey").alias("county_key"))
    kept = dimension.keep_listed(t.responses, "county_key", ids, n=dimension.LIST_BROADCAST + 1)
    return kept.groupBy("county_key").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}


def _llm():
    """The training-data operators and the corpus pipeline, where they are installed."""
    try:
        import corpus_pipeline
        from regionpanel.llm import queries as llm_queries
        from regionpanel.llm import sql as llm_sql
    except ModuleNotFoundError as e:
        if e.name not in ("corpus_pipeline", "regionpanel.llm", "regionpanel.llm.queries", "regionpanel.llm.sql"):
            raise
        return {}, {}
    sql = dict(llm_sql.ORACLE)
    if corpus_pipeline.ORACLE_SQL is not None:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return llm_queries.queries() | {"pipeline": corpus_pipeline.run}, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES) | _llm()[0]


def oracle_sql() -> dict[str, str]:
    from oracle_sql import ORACLE

    return {k: v for k, v in ORACLE.items() if k in _QUERIES} | _llm()[1]


__all__ = ["entry", "queries", "oracle_sql"]
