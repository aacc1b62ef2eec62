"""Column groups and labels.

The header dictionary maps a column name to a group (``Census Variables``,
``State variables`` ...). Export columns are matched on a normalised label
(K11); unknown columns fall in ``Other``. The result is a *column
dictionary* DataFrame (ordinal, column, group, label) written beside the
export, and the same facts stamped into column metadata.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionpanel.functions.keys import normalise_label, qcol

DEFAULT_GROUP = "Other"

# Friendly labels of the score sums (fixed values, P4).
SUM_LABELS = {
    "Reg_Sum": "Provison of Information About Registration (Overall Score)",
    "Voting_Sum": "Provision of Information About Voting (Overall Score)",
    "Abuses_Sum": "History of Voting Rights Abuses in County",
    "pollworkers_Sum": "Availability of Poll Workers (Overall Score)",
    "Drives_Sum": "Registration Drives",
    "dropboxes_Sum": "Drop Box Availability",
    "Vote Centers_Sum": "Vote Center Availability",
    "Ease of Registration_Sum": "Ease of Registration (Overall Score)",
}

# Category key -> description shown for it (fixed values, P5).
CATEGORY_LABELS = {
    "Reg": "The Provision of Information About Registration (5 item additive scale)",
    "Voting": "The Provision of Information About Voting",
    "Abuses": "History of Voting Rights Abuses in County (3 item Likert scale)",
    "pollworkers": "Availability of Poll Workers (6 item additive scale)",
    "Registration": "Registration Drives (dichotomous 0/1)",
    "dropboxes": "Alternative Voting: Drop Boxes (dichotomous 0/1)",
    "Vote Centers": "Alternative Voting: Vote Centers (dichotomous 0/1)",
    "Ease of Registration": "Ease of Registration (4 item additive scale)",
}

# Column renamed before labelling (L12; unconditional in the reference).
RENAMES = {"Registration_Sum": "Drives_Sum"}


def read_header_dictionary(spark: SparkSession, path) -> DataFrame:
    """CSV files with ``name`` and ``header`` columns (others ignored).

    ``path`` is a file, a folder or a list of files. ``ordinal`` says where an
    entry stands - place of the file (in the list, else by its name), byte at
    which the split starts, row in the split - so that a later duplicate wins
    under any number of splits, tasks and files. Rows of one split are read in
    order by one task, which numbers them."""
    parts = []
    for i, one in enumerate([path] if isinstance(path, str) else path):
        raw = spark.read.option("header", True).option("multiLine", True).csv(one)
        missing = {"name", "header"} - set(raw.columns)
        if missing:
            raise ValueError(f"header dictionary lacks columns {sorted(missing)}")
        at = F.col("_metadata")
        place = F.struct(F.lit(i).alias("given"), at["file_path"].alias("file"), at["file_block_start"].alias("start"),
                         F.monotonically_increasing_id().alias("row"))
        parts.append(raw.select(place.alias("ordinal"), "name", "header"))
    return reduce(DataFrame.unionByName, parts)


def header_lookup(dictionary: DataFrame) -> DataFrame:
    """normalised name -> header, the last entry of a name winning."""
    return (dictionary.select(normalise_label("name").alias("key"), "ordinal", "header")
            .groupBy("key").agg(F.max_by("header", "ordinal").alias("header")))


def label_map(spark: SparkSession, mapping: dict[str, str], key: str = "key",
              value: str = "label") -> DataFrame:
    return spark.createDataFrame(list(mapping.items()), f"`{key}` string, `{value}` string")


def column_dictionary(df: DataFrame, dictionary: DataFrame, default: str = DEFAULT_GROUP) -> DataFrame:
    """(ordinal, column, group, label) for every column of ``df``."""
    spark = df.sparkSession
    cols = spark.createDataFrame(list(enumerate(df.columns)), "ordinal int, column string")
    labels = label_map(spark, SUM_LABELS, "column", "friendly")
    return (cols.withColumn("key", normalise_label("column"))
            .join(header_lookup(dictionary), "key", "left")
            .join(F.broadcast(labels), "column", "left")          # fixed eight rows
            .select("ordinal", "column",
                    F.coalesce("header", F.lit(default)).alias("group"),
                    F.coalesce("friendly", "column").alias("label")))


def rename_columns(df: DataFrame, renames: dict[str, str] = RENAMES) -> DataFrame:
    for old, new in renames.items():
        if old in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def apply_headers(df: DataFrame, dictionary: DataFrame, default: str = DEFAULT_GROUP) -> DataFrame:
    """Stamps ``group``/``label`` into each column's metadata (kept by
    select and by Parquet). Collects only the column dictionary: one row
    per column."""
    groups = {r.column: (r.group, r.label) for r in column_dictionary(df, dictionary, default).collect()}
    return df.select(*[
        qcol(c).alias(c, metadata={"group": groups[c][0], "label": groups[c][1]}) for c in df.columns
    ])


def two_row_header(df: DataFrame) -> list[list[str]]:
    """The two header rows (group row, label row) of a labelled frame."""
    fields = df.schema.fields
    return [[f.metadata.get("group", DEFAULT_GROUP) for f in fields],
            [f.metadata.get("label", f.name) for f in fields]]


def category_labels(categories: DataFrame, column: str = "category") -> DataFrame:
    """P5: category -> display description (the key itself when unknown)."""
    spark = categories.sparkSession
    m = label_map(spark, CATEGORY_LABELS, column, "description")
    return (categories.join(F.broadcast(m), column, "left")        # fixed eight rows
            .select(column, F.coalesce("description", column).alias("label")))
