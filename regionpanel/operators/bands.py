"""Population density and the rural / suburban / urban band.

density = population / land area. A zero area gives NULL density (never
inf/NaN: Spark orders NaN above every number, so ``NaN > 2000`` would be
true). The band reproduces the reference's float outcomes explicitly:
positive population over zero area is Urban (x/0 = inf), negative is
Rural (-inf), zero over zero has no band (NaN); a missing input has no
band. ``All`` keeps every row; an unknown band keeps every row too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionpanel.functions.keys import qcol
from regionpanel.operators.wide import variable_label
from regionpanel.sources.schema import LAND_AREA, LAND_AREA_ID, POPULATION, POPULATION_ID

# Band limits in people per square mile (fixed values).
RURAL_BELOW = 150.0
URBAN_ABOVE = 2000.0
DENSITY_COLUMN = "Population Density"
BAND_COLUMN = "density_band"

POPULATION_COLUMN = variable_label(POPULATION_ID, POPULATION)
LAND_AREA_COLUMN = variable_label(LAND_AREA_ID, LAND_AREA)


def density(pop, area):
    return F.try_divide(pop.cast("double"), area.cast("double"))


def band(pop, area, rural_below: float = RURAL_BELOW, urban_above: float = URBAN_ABOVE):
    p, a = pop.cast("double"), area.cast("double")
    d = F.try_divide(p, a)
    return (F.when(p.isNull() | a.isNull(), F.lit(None))
            .when((a == 0) & (p > 0), F.lit("Urban"))
            .when((a == 0) & (p < 0), F.lit("Rural"))
            .when(a == 0, F.lit(None))
            .when(d < rural_below, F.lit("Rural"))
            .when(d <= urban_above, F.lit("Suburban"))
            .otherwise(F.lit("Urban")))


def with_density(df: DataFrame, pop_col: str = POPULATION_COLUMN, area_col: str = LAND_AREA_COLUMN,
                 with_band: bool = False) -> DataFrame:
    """Adds ``Population Density`` (and the band). Missing inputs raise
    KeyError as in the reference."""
    for c in (pop_col, area_col):
        if c not in df.columns:
            raise KeyError(c)
    out = df.withColumn(DENSITY_COLUMN, density(qcol(pop_col), qcol(area_col)))
    if with_band:
        out = out.withColumn(BAND_COLUMN, band(qcol(pop_col), qcol(area_col)))
    return out


def filter_by_band(df: DataFrame, band_name: str, pop_col: str = POPULATION_COLUMN,
                   area_col: str = LAND_AREA_COLUMN) -> DataFrame:
    """Keep the rows of one band (All / unknown: every row).

    Adds the density column like the reference does. Deviation: with
    ``All`` and no population / area column the frame passes unchanged
    instead of raising."""
    if band_name not in ("Rural", "Suburban", "Urban"):
        if pop_col not in df.columns or area_col not in df.columns:
            return df
        return with_density(df, pop_col, area_col)
    out = with_density(df, pop_col, area_col)
    return out.where(band(qcol(pop_col), qcol(area_col)) == F.lit(band_name))
