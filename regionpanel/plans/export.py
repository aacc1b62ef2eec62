"""The export job.

``export_frame`` builds the whole request as ONE logical plan:

    spine (counties x states, scoped)
      LEFT JOIN census block   (facts -> groupBy county_key, conditional max)
      LEFT JOIN score block    (responses x questions -> ONE groupBy county_key,
                                sums per category and per chosen question)
      LEFT JOIN state columns  (state_wide, by state_key)
      WHERE the county belongs to at least one block

``finish`` applies the band filter, the rename and the column headers;
``run_export`` writes the result (Parquet or CSV) with its column
dictionary and the request, then profiles the *written* data, so the plan
runs once and the profile does not depend on a cached lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionpanel.operators import bands, headers
from regionpanel.operators.assemble import assemble_counties, state_frame
from regionpanel.operators.profile import profile
from regionpanel.operators.scores import Block, score_block_list
from regionpanel.operators.wide import census_block, resolve_census_variables, variable_label
from regionpanel.plans.spec import ExportSpec
from regionpanel.sources.schema import META
from regionpanel.sources.sinks import write_frame, write_two_row_csv
from regionpanel.sources.tables import Tables


def census_variables_of(tables: Tables, spec: ExportSpec) -> dict[int, str]:
    if not spec.census_variables and not spec.mandatory_variables:
        return {}
    return resolve_census_variables(tables, spec.census_variables, spec.mandatory_variables)


def export_frame(tables: Tables, spec: ExportSpec, duplicates: str = "raise") -> DataFrame:
    """X1 (state scope) / X2 (county scope) before band filter and labels.

    Nothing county-level asked -> the state frame alone (state_id + state
    columns). Nothing at all -> a typed empty frame of the meta columns.
    Two census facts of one county and variable fail the job unless
    ``duplicates="largest"``.
    """
    variables = census_variables_of(tables, spec)
    blocks: list[Block] = []
    if variables:
        labels = [variable_label(v, n) for v, n in variables.items()]
        blocks.append(Block(census_block(tables, spec.scope, variables, duplicates), labels))
    blocks += score_block_list(tables, spec.scope, spec.categories, spec.sum_suffix)
    state_cols = list(spec.state_variables)
    if not blocks:
        if state_cols:
            return state_frame(tables, spec.scope, state_cols).orderBy("state_id")
        spark = tables.states.sparkSession
        return spark.createDataFrame([], ", ".join(f"{m} string" for m in META))
    return assemble_counties(tables, spec.scope, blocks, state_cols)


def finish(df: DataFrame, spec: ExportSpec, dictionary: DataFrame | None,
           drop_density: bool = True, order: bool = True, drop_helpers: bool = False) -> DataFrame:
    """X3 after the merge: band filter (adds density), rename, headers, drop
    the density helper column, final order (nulls last).

    L11: the reference means to drop land area too but never does (its
    column test misses the id prefix); ``drop_helpers=True`` drops both."""
    if "county_id" in df.columns:
        df = bands.filter_by_band(df, spec.band)
    df = headers.rename_columns(df)
    if drop_density and bands.DENSITY_COLUMN in df.columns:
        df = df.drop(bands.DENSITY_COLUMN)
    if drop_helpers and bands.LAND_AREA_COLUMN in df.columns:
        df = df.drop(bands.LAND_AREA_COLUMN)
    if dictionary is not None:
        df = headers.apply_headers(df, dictionary)
    if order:
        keys = [c for c in ("state_id", "county_id") if c in df.columns]
        df = df.orderBy(*[F.col(k).asc_nulls_last() for k in keys])
    return df


def export(tables: Tables, spec: ExportSpec, labelled: bool = False, ordered: bool = True,
           duplicates: str = "raise") -> DataFrame:
    """The finished export of a request, as one plan. Building it runs only
    small jobs: the lookups of the requested names and, for a state scope, a
    count of the scope's counties (both memoised on ``tables``).

    ``ordered=False`` skips the final global sort (a sampling job and a
    range shuffle) for consumers that do not care about row order, such as
    the profile or a row count."""
    dictionary = tables.header_dictionary if labelled else None
    return finish(export_frame(tables, spec, duplicates), spec, dictionary, order=ordered)


def run_export(tables: Tables, spec: ExportSpec, out_dir: str, fmt: str = "parquet",
               with_profile: bool = True, two_row_header: bool = False, duplicates: str = "raise") -> dict:
    """Write data, column dictionary and request; profile the written
    data. Returns paths and the row count.

    ``two_row_header`` (CSV only) also writes the reference's download form:
    a group row and a label row above the sorted data, in parts."""
    spark = tables.states.sparkSession
    dictionary = tables.header_dictionary
    df = export(tables, spec, labelled=dictionary is not None, duplicates=duplicates)
    data_path = f"{out_dir}/data"
    write_frame(df, data_path, fmt)
    if two_row_header and fmt == "csv":
        write_two_row_csv(spark.read.schema(df.schema).option("header", True).csv(data_path),
                          f"{out_dir}/download")
    if dictionary is not None:
        headers.column_dictionary(df, dictionary).coalesce(1).write.mode("overwrite") \
            .parquet(f"{out_dir}/columns")
    spark.createDataFrame([(spec.to_json(),)], "request string").coalesce(1).write.mode("overwrite") \
        .text(f"{out_dir}/request")
    reader = spark.read.format(fmt).schema(df.schema)
    written = (reader.option("header", True) if fmt == "csv" else reader).load(data_path)
    result = {"data": data_path, "rows": written.count()}
    if with_profile:
        prof_path = f"{out_dir}/profile"
        profile(written).write.mode("overwrite").parquet(prof_path)
        result["profile"] = prof_path
    return result


def read_request(spark, out_dir: str) -> ExportSpec:
    text = spark.read.text(f"{out_dir}/request").first()[0]
    return ExportSpec.from_json(text)

