"""Quarantined facts, ordered header dictionaries, the download as one file."""

import glob
import os

from pyspark.sql import functions as F

from regionpanel.operators import headers
from regionpanel.plans import requests as R
from regionpanel.plans.export import export
from regionpanel.sources.fixture import stored_relations
from regionpanel.sources.quarantine import NO_KEY, NO_NUMBER, NO_REGION, OK, load_facts
from regionpanel.sources.sinks import write_download, write_two_row_csv
from regionpanel.sources.tables import Tables
from tests.conftest import SF_SMALL


def test_refused_facts_are_told_apart_in_one_scan(spark, scratch):
    stored = stored_relations(spark, SF_SMALL)
    stored["responses"] = spark.createDataFrame(
        [("17", 1, "2"), ("0017", 1, " 3.5 "), ("17", 2, None), ("17", 2, "n/a"), (None, 2, "1"), ("  ", 3, "x"), ("18", None, "4"), ("18", 5, "Infinity")],
        "county_id string, question_id long, value string")
    loaded, refused, counts = load_facts(stored, scratch)
    assert counts["responses"] == {OK: 4, NO_REGION: 2, NO_KEY: 1, NO_NUMBER: 1}
    got = sorted(map(tuple, refused.where("relation = 'responses'").collect()), key=repr)
    assert got == sorted([("responses", NO_NUMBER, "17", "2", "n/a"), ("responses", NO_REGION, None, "2", "1"),
                          ("responses", NO_REGION, "  ", "3", "x"), ("responses", NO_KEY, "18", None, "4")], key=repr)
    tables = Tables.from_stored(**loaded)
    assert tables.responses.agg(F.sum(F.when(F.col("county_key") == "17", F.col("value")))).first()[0] == 5.5
    assert counts["census_facts"][OK] == stored["census_facts"].count() and refused.where("relation = 'census_facts'").count() == 0


def test_the_last_entry_wins_over_files_and_splits(spark, scratch):
    first, second = f"{scratch}/b.csv", f"{scratch}/a.csv"
    with open(first, "w") as f:
        f.write("name,header\n" + "".join(f"v{i % 50},one {i}\n" for i in range(3000)))
    with open(second, "w") as f:
        f.write("header,name,note\n" + "".join(f"two {i},v{i % 20},x\n" for i in range(600)))
    want = {f"v{k}": f"two {580 + k}" if k < 20 else f"one {2950 + k}" for k in range(50)}
    os.makedirs(f"{scratch}/both/")
    for n, (size, paths) in enumerate([("128m", [first, second]), ("1k", [first, second])]):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            d = headers.read_header_dictionary(spark, paths)
            for df in (d, d.repartition(7)):
                assert {r.key: r.header for r in headers.header_lookup(df).collect()} == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    # without a list the files' names decide
    os.replace(first, f"{scratch}/both/2.csv")
    os.replace(second, f"{scratch}/both/1.csv")
    with open(f"{scratch}/both/1.csv") as f:
        lines = f.read().replace("header,name,note", "name,header,note").splitlines()
    with open(f"{scratch}/both/1.csv", "w") as f:
        f.write("\n".join([lines[0].replace(",note", "")] + [",".join(reversed(x.split(",")[:2])) for x in lines[1:]]) + "\n")
    got = {r.key: r.header for r in headers.header_lookup(headers.read_header_dictionary(spark, f"{scratch}/both")).collect()}
    assert got == {f"v{k}": f"one {2950 + k}" for k in range(50)}


def test_download_is_the_concatenation_of_the_parts(spark, small_tables, scratch, monkeypatch):
    df = export(small_tables, R.state_full(), labelled=True, ordered=False).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        size = write_download(df, f"{scratch}/panel.csv", keep_parts=True)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = sorted(glob.glob(f"{scratch}/panel.csv.parts-*/part-*"))
    assert len(parts) > 3
    with open(f"{scratch}/panel.csv", "rb") as f:
        whole = f.read()
    assert whole == b"".join(open(p, "rb").read() for p in parts) and len(whole) == size
    lines = whole.decode().splitlines()
    assert len(lines) == 2 + df.count() and "identifier" in lines[0] and "county_id" in lines[1]
    ids = [tuple(x.split(",")[i] for i in (0, 2)) for x in lines[2:]]
    assert ids == sorted(ids)
    assert not glob.glob(f"{scratch}/*.part")
    # a second download takes the first one's place and leaves no parts
    write_download(df.limit(3), f"{scratch}/panel.csv")
    assert len(open(f"{scratch}/panel.csv").read().splitlines()) == 5 and len(glob.glob(f"{scratch}/panel.csv.parts-*")) == 1


def test_download_of_an_empty_export(spark, small_tables, scratch):
    df = export(small_tables, R.state_full(R.Scope.states("ZZ")), labelled=True)
    write_download(df, f"{scratch}/none.csv")
    assert len(open(f"{scratch}/none.csv").read().splitlines()) == 2
    write_two_row_csv(df, f"{scratch}/parts")
