import datetime as dt

from pyspark.sql import functions as F

from regionpanel.llm import url_lists as M

D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)


def run(spark, caps, entries):
    c = spark.createDataFrame(caps, "page_id long, url string, day date, action string, pattern string")
    e = spark.createDataFrame(entries, "pattern string, day date, action string, url string")
    return sorted([tuple(r) for r in M.evaluate(c, e).select("page_id", "action", "pattern", "listed_since", "listed_until").collect()], key=repr)


def test_as_of_and_specificity(spark):
    entries = [("example.com", D(10), "block", "x"), ("example.com", D(20), "delist", "x"), ("a.example.com", D(12), "allow", "x"),
               ("a.example.com/shop", D(15), "block", "x"), ("example.com", D(10), "allow", "x"), (None, D(1), "block", "x"), ("b.org", None, "block", "x")]
    caps = [(1, "http://example.com/x", D(9)), (2, "http://example.com/x", D(10)), (3, "http://Example.COM:80", D(19)),
            (4, "http://example.com", D(20)), (5, "http://u@a.example.com/", D(13)), (6, "https://a.example.com/shop/1?q", D(15)),
            (7, "https://z.a.example.com/shop", D(11)), (8, None, D(15)), (9, "no url", D(15)), (10, "http://example.com", None),
            (11, "http://b.org", D(5)), (12, "", D(5))]
    got = {r[0]: r[1:] for r in run(spark, [(*c, "clash", "clash") for c in caps], entries)}
    assert got[2] == ("block", "example.com", D(10), D(20)) and got[3][0] == "block"
    assert got[5] == ("allow", "a.example.com", D(12), None)
    assert got[6] == ("block", "a.example.com/shop", D(15), None)
    assert got[7] == ("block", "example.com", D(10), D(20))
    assert all(got[i] == ("none", None, None, None) for i in (1, 4, 8, 9, 10, 11, 12))


def test_repeated_rows_and_a_hot_host(spark):
    caps = [(i // 2, "http://hot.net/p", D(i // 2 % 40), "", "") for i in range(2000)]
    got = run(spark, caps, [("hot.net", D(5), "block", ""), ("hot.net", D(9), "allow", "")])
    assert len(got) == 2000
    assert sum(r[1] == "block" for r in got) == 2 * sum(5 <= i % 40 < 9 for i in range(1000))


def test_empty_tables(spark):
    assert run(spark, [], [("a.b", D(1), "block", "")]) == []
    assert run(spark, [(1, "http://a.b", D(1), "", "")], []) == [(1, "none", None, None, None)]


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", "")], "page_id long, url string, html string").where(F.lit(True))
    plan = M.filtered_captures(pages)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_addresses_and_trailing_dots(spark):
    urls = ["http://10.1.2.3/a", "http://[::1]:80/x/y", "http://EX.com./p", "http://a.ex.com..", "http://u@1.2.3.4:9/", "http://1.2.3.4.5/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: [x.pattern for x in r.p] for r in df.select("url", M.patterns(F.col("url")).alias("p")).collect()}
    assert got[urls[0]] == ["10.1.2.3", "10.1.2.3/a"] and got[urls[1]] == ["[::1]", "[::1]/x"]
    assert got[urls[2]] == ["ex.com", "ex.com/p"] and got[urls[3]] == ["a.ex.com", "ex.com"]
    assert got[urls[4]] == ["1.2.3.4"] and got[urls[5]][0] == "1.2.3.4.5" and got[urls[5]][-1] == "4.5"
