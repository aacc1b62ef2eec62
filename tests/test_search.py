"""Trigram search against the plain scan; Bloom filter of a long list."""

import random
import re

import pytest
from pyspark.sql import functions as F

from regionpanel.operators import dimension as D
from regionpanel.operators import search as S
from regionpanel.operators.lookups import catalogue_search


@pytest.fixture(scope="module")
def catalogue(spark):
    rng = random.Random(8)
    letters = "aabbcÄéß 日本\U0001f600#."
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    texts += ["aaaaaaa", "ab", "a", "", None, "x" * 50, "Ärger mit ÄRGER", "end\x00 nul"]
    return spark.createDataFrame(list(enumerate(texts)), "question_id long, question string")


@pytest.fixture(scope="module")
def index(spark, catalogue):
    import tempfile
    path = tempfile.mkdtemp(prefix="rp-index-") + "/i"
    S.write_index(catalogue, path, "question_id", "question")
    return S.read_index(spark, path)


def test_equals_the_scan_for_queries_of_every_length(spark, catalogue, index):
    rng = random.Random(3)
    rows = [r.question for r in catalogue.collect() if r.question]
    queries = ["", " ", "a", "ä", "aa", "aaa", "aaaa", "日本", "ÄRGER", "zzz", "x" * 40, "x" * 50, "x" * 51, "\x00", "d\x00 n", "ab\x00"]
    for n in (1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 31, 40):
        text = rng.choice([r for r in rows if len(r) >= n])
        at = rng.randrange(len(text) - n + 1)
        queries.append(text[at:at + n].upper() if n % 2 else text[at:at + n])
    for q in queries:
        got = {r.question_id for r in S.indexed_search(catalogue, index, "question_id", "question", q).collect()}
        want = {r.question_id for r in catalogue_search(catalogue, "question", q).collect()}
        assert got == want, q


def test_places_are_counted(index):
    got = {r.id: (r.first_place, r.n_places) for r in S.search_places(index, "aaa").collect()}
    assert got[300] == (0, 5)


def test_the_plan_reads_no_text(catalogue, index):
    plan = S.search_places(index, "日本a b")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "ReadSchema: struct<gram:string,id:bigint,places:array<int>>" in plan
    assert re.search(r"PartitionFilters: \[[^\]]*part#", plan) and "PushedFilters: [In(gram" in plan


def test_many_matches_join(spark, catalogue, index, monkeypatch):
    monkeypatch.setattr(S, "IN_LIST_LIMIT", 3)
    got = S.indexed_search(catalogue, index, "question_id", "question", "a")
    assert got.columns == catalogue.columns
    assert got.count() == catalogue_search(catalogue, "question", "a").count()


def test_bloom_filter_thins_the_rows_before_the_join(spark):
    ids = spark.range(0, 40_000, 2).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("county_key"))
    facts = spark.range(200_000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("county_key"), "id")
    facts = facts.unionByName(spark.createDataFrame([(None, -1)], "county_key string, id long"))
    words = D.bloom_filter(ids, "county_key", D.bloom_size(20_000))
    passed = facts.where(D.might_hold(F.col("county_key"), words))
    assert passed.join(ids, "county_key", "left_semi").count() == 20_000  # none is lost
    assert passed.count() < 20_000 + 0.02 * 180_000
    kept = D.keep_listed(facts, "county_key", ids, n=D.LIST_BROADCAST + 1)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert {r.id for r in kept.collect()} == set(range(0, 40_000, 2))


def test_no_plan_holds_the_filter(spark):
    ids = spark.range(0, 40_000, 2).select(F.col("id").cast("string").alias("k"))
    rows = spark.range(100_000).select(F.col("id").cast("string").alias("k"))
    kept = D.keep_listed(rows, "k", ids, n=D.LIST_BROADCAST + 1)
    assert len(kept._jdf.queryExecution().toString()) < 200_000  # the filter has 1.5 MB, every time it is written out
    assert kept.count() == 20_000


def test_every_word_of_the_filter_is_in_its_place(spark):
    ids = spark.range(500).select(F.col("id").cast("string").alias("k"))
    bits = 64 * (2 * D.BLOOM_BLOCK + 5)  # two whole blocks of words and a part
    words = spark.range(1).select(D.bloom_filter(ids, "k", bits).words.alias("w")).first().w
    at = ids.select(F.explode(F.array(*D._bloom_places(F.col("k"), bits))).alias("at")).distinct().collect()
    assert len(words) == bits // 64
    assert {i * 64 + j for i, x in enumerate(words) for j in range(64) if x >> j & 1} == {r["at"] for r in at}


def test_a_filter_that_may_not_grow_still_loses_no_row(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOOM_MOST", 1 << 10)
    ids = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    rows = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    assert D.keep_listed(rows, "k", ids, n=D.LIST_BROADCAST + 1).count() == 3000
    assert D.keep_listed(rows, "k", ids.limit(0), n=D.LIST_BROADCAST + 1).count() == 0


def test_long_python_lists_go_the_same_way(spark, monkeypatch):
    monkeypatch.setattr(D, "IN_LIST_LIMIT", 10)
    monkeypatch.setattr(D, "LIST_BROADCAST", 100)
    rows = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    assert D.keep_keys(rows, "k", [str(i) for i in range(0, 900, 3)]).count() == 300
