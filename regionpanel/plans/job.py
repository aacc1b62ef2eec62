"""Command-line export job (X3), for ``spark-submit``.

    spark-submit --py-files regionpanel.zip regionpanel/plans/job.py --snapshot /data/panel/v42 \
        --request request.json --out /data/exports/run-7 --format csv

``--snapshot`` reads a canonical snapshot (``Tables.load``) or the newest
version of a snapshot store (``--version`` another one), pinned while the job
runs; ``--publish`` writes the next version of a store; ``--fixture`` derives the star schema from the TPC-H-like test tables instead. The
request is an ``ExportSpec`` as JSON (file path or literal). Cluster
settings (executors, memory, ``spark.checkpoint.dir``) come from
spark-submit; this job only sets SQL options.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from regionpanel.plans.export import run_export
from regionpanel.plans.spec import ExportSpec
from regionpanel.session import configure


def _request(text: str) -> ExportSpec:
    if os.path.exists(text):
        with open(text) as fh:
            text = fh.read()
    return ExportSpec.from_json(text)


def main(argv: list[str] | None = None) -> dict:
    ap = argparse.ArgumentParser(description="Region-panel export")
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--snapshot", help="canonical snapshot, or a store of published versions")
    src.add_argument("--fixture", help="directory of the TPC-H-like test tables")
    src.add_argument("--stored", help="folder of stored-form relations (Tables.read_stored)")
    ap.add_argument("--stored-format", default="parquet", choices=["parquet", "csv", "orc", "json"])
    ap.add_argument("--header-dictionary", help="CSV with name and header columns: groups the exported columns "
                    "(a snapshot written with it keeps it)")
    ap.add_argument("--lenient", action="store_true",
                    help="stored relations only: measure texts that are no numbers become NULL instead of failing")
    ap.add_argument("--keep-largest", action="store_true", help="a repeated census fact keeps its largest value instead of failing")
    ap.add_argument("--version", type=int, help="version of the snapshot store (default: the newest)")
    ap.add_argument("--write-snapshot", help="write the canonical snapshot here and stop")
    ap.add_argument("--publish", help="publish the tables as the next version of this snapshot store and stop")
    ap.add_argument("--request", help="ExportSpec JSON (path or literal)")
    ap.add_argument("--out", help="output directory")
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv", "orc", "json"])
    ap.add_argument("--no-profile", action="store_true")
    ap.add_argument("--two-row-header", action="store_true",
                    help="CSV only: also write the download form with group and label header rows")
    args = ap.parse_args(argv)

    spark = configure(SparkSession.builder.appName("regionpanel-export").getOrCreate())
    from contextlib import ExitStack

    from regionpanel.sources.tables import Tables
    from regionpanel.sources.versions import SnapshotStore
    held = ExitStack()
    if args.snapshot and SnapshotStore.is_store(spark, args.snapshot):
        tables = held.enter_context(SnapshotStore(spark, args.snapshot).pinned(args.version))
    elif args.snapshot:
        tables = Tables.load(spark, args.snapshot)
    elif args.stored:
        tables = Tables.read_stored(spark, args.stored, args.stored_format, strict_measures=not args.lenient)
        tables.check_keys()
    else:
        from regionpanel.sources.fixture import fixture_tables
        tables = fixture_tables(spark, args.fixture)
    with held:
        return _run(ap, args, spark, tables)


def _run(ap, args, spark, tables) -> dict:
    if args.header_dictionary:
        from regionpanel.operators.headers import read_header_dictionary
        tables = tables.with_header_dictionary(read_header_dictionary(spark, args.header_dictionary))
    if args.publish:
        from regionpanel.sources.versions import SnapshotStore
        result = {"snapshot": args.publish, "version": SnapshotStore(spark, args.publish).publish_tables(tables).number}
    elif args.write_snapshot:
        tables.write_snapshot(args.write_snapshot)
        result = {"snapshot": args.write_snapshot}
    elif not args.request or not args.out:
        ap.error("--request and --out are required for an export")
    else:
        result = run_export(tables, _request(args.request), args.out, args.format, not args.no_profile,
                            args.two_row_header, "largest" if args.keep_largest else "raise")
    print(json.dumps(result))
    return result


if __name__ == "__main__":
    main(sys.argv[1:])
