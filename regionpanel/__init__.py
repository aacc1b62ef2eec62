"""regionpanel: region-panel exports as Spark DataFrame plans.

Long fact tables (census measures and survey responses per county), their
dictionaries and a wide state table go in; one wide row per county comes out.
Every step is a DataFrame plan: no Python UDF, no collected fact table.

Layout
------
functions/  column expressions (key canonicalisation, labels, measures)
sources/    table schemas, loading, fixture mapping, sinks
operators/  lookups, reshapes, scores, joins, bands, headers, profiles
plans/      export spec and the export job
streaming/  (empty: the exporter is batch only)
"""

from regionpanel.sources.tables import Tables  # noqa: F401
from regionpanel.plans.spec import CategoryChoice, ExportSpec, Scope  # noqa: F401

__all__ = ["Tables", "ExportSpec", "CategoryChoice", "Scope"]
