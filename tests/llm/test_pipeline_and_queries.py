import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline
from regionpanel.llm import queries, sql
from regionpanel.llm.common import staged
from tests.conftest import SF_SMALL
from tests.llm import cases
from tools.check_oracle import TABLES, digest


def test_registered():
    names = set(E.queries())
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()}
    assert "pipeline" in names and set(sql.ORACLE) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(sql.ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    con.sql(sql.ORACLE[name]).create_view("oracle_view")
    df = queries.queries()[name](spark, SF_SMALL)
    cur = con.execute(sql.ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(cols, cur.fetchall())[0]


def test_pipeline_on_the_small_tables(spark):
    out = corpus_pipeline.run(spark, SF_SMALL)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert out.columns[:len(docs.columns)] == docs.columns
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 0 < len(ids) < docs.count()


def test_stages_take_awkward_rows_and_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, cases.OTHER)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for rows in (None, []):
        df = cases.docs(spark, rows)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = staged(stage(spark, df, d), name)
            assert out.columns[:len(df.columns)] == df.columns
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == df.columns
                df = out
        ids = [r.doc_id for r in out.collect()]
        if rows is None:
            assert 1 in ids and 2 not in ids and 4 not in ids and ids.count(None) == 2 and {5, 6, 7, 8, 9} <= set(ids)
        else:
            assert ids == []
