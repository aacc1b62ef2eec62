"""The export job end to end: write, dictionary, request, profile, CSV forms."""

import csv
import glob

from regionpanel.plans import requests as R
from regionpanel.plans.export import export, read_request, run_export
from regionpanel.sources.sinks import write_two_row_csv


def test_run_export_parquet(spark, small_tables, scratch):
    spec = R.state_full()
    res = run_export(small_tables, spec, scratch, fmt="parquet")
    data = spark.read.parquet(res["data"])
    expected = export(small_tables, spec)
    assert sorted(map(tuple, data.collect())) == sorted(map(tuple, expected.collect()))
    assert res["rows"] == expected.count()
    cols = spark.read.parquet(f"{scratch}/columns").orderBy("ordinal").collect()
    assert [c.column for c in cols] == expected.columns
    assert read_request(spark, scratch) == spec
    prof = {r.column: r for r in spark.read.parquet(res["profile"]).collect()}
    assert prof["1: Overall Population"]["count"] == data.where("`1: Overall Population` IS NOT NULL").count()
    # group metadata survives Parquet
    assert data.schema["1: Overall Population"].metadata.get("group") == "Census Variables"


def test_run_export_csv_roundtrip(spark, small_tables, scratch):
    spec = R.county_full()
    res = run_export(small_tables, spec, scratch, fmt="csv", with_profile=False)
    expected = export(small_tables, spec)
    back = spark.read.schema(expected.schema).option("header", True).csv(res["data"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, expected.collect()))


def test_two_row_header_csv(spark, small_tables, scratch):
    df = export(small_tables, R.state_full(), labelled=True)
    write_two_row_csv(df, f"{scratch}/two")
    rows = []
    for f in sorted(glob.glob(f"{scratch}/two/part-*.csv")):
        with open(f, newline="") as fh:
            rows += list(csv.reader(fh))
    assert rows[0][:4] == ["identifier"] * 4
    assert rows[1][:4] == ["state_id", "state_name", "county_id", "county_name"]
    assert "Registration Drives" in rows[1]                       # Drives_Sum friendly label
    assert len(rows) == 2 + df.count()
    ids = [(r[0], r[2]) for r in rows[2:]]
    assert ids == sorted(ids)


def test_cli_job_runs_from_a_request_file(spark, scratch):
    from regionpanel.plans.job import main

    spec = R.county_full()
    path = f"{scratch}/request.json"
    with open(path, "w") as fh:
        fh.write(spec.to_json())
    res = main(["--fixture", "/root/testdata/sf0.001", "--request", path, "--out", f"{scratch}/out",
                "--format", "parquet"])
    assert res["rows"] == 2
    assert spark.read.parquet(res["profile"]).count() > 0


def test_read_stored_relations_from_files(spark, small_tables, scratch):
    from regionpanel.sources.fixture import stored_relations
    from regionpanel.sources.tables import Tables

    for name, df in stored_relations(spark, "/root/testdata/sf0.001").items():
        df.write.mode("overwrite").parquet(f"{scratch}/stored/{name}")
    t = Tables.read_stored(spark, f"{scratch}/stored", header_dictionary=small_tables.header_dictionary)
    spec = R.state_full()
    a = sorted(map(tuple, export(t, spec).collect()))
    b = sorted(map(tuple, export(small_tables, spec).collect()))
    assert a == b and len(a) > 0


def test_read_stored_from_csv_and_export_formats(spark, small_tables, scratch):
    from regionpanel.sources.fixture import stored_relations
    from regionpanel.sources.sinks import write_frame
    from regionpanel.sources.tables import Tables

    for name, df in stored_relations(spark, "/root/testdata/sf0.001").items():
        df.write.mode("overwrite").option("header", True).csv(f"{scratch}/csv/{name}")
    t = Tables.read_stored(spark, f"{scratch}/csv", fmt="csv", header_dictionary=small_tables.header_dictionary)
    spec = R.county_full()
    expected = sorted(map(tuple, export(small_tables, spec).collect()))
    assert sorted(map(tuple, export(t, spec).collect())) == expected
    df = export(small_tables, spec)
    for fmt in ("orc", "json"):
        write_frame(df, f"{scratch}/out-{fmt}", fmt)
        back = spark.read.format(fmt).schema(df.schema).load(f"{scratch}/out-{fmt}")
        assert sorted(map(tuple, back.collect())) == expected


def test_run_export_with_two_row_download(spark, small_tables, scratch):
    res = run_export(small_tables, R.state_full(), scratch, fmt="csv", with_profile=False, two_row_header=True)
    rows = []
    for f in sorted(glob.glob(f"{scratch}/download/part-*.csv")):
        with open(f, newline="") as fh:
            rows += list(csv.reader(fh))
    assert rows[0][:4] == ["identifier"] * 4 and len(rows) == 2 + res["rows"]


def test_cli_writes_a_snapshot_then_exports_from_it(spark, scratch):
    from regionpanel.plans.job import main

    main(["--fixture", "/root/testdata/sf0.001", "--write-snapshot", f"{scratch}/snap"])
    res = main(["--snapshot", f"{scratch}/snap", "--request", R.county_full().to_json(), "--out", f"{scratch}/out",
                "--no-profile"])
    assert res["rows"] == 2
