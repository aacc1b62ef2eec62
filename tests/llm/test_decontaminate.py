from regionpanel.llm import decontaminate as M
from tests.llm import cases

ITEM = ("Alice buys 12 apples at the market for 3 dollars each. How many dollars does Alice pay when she also takes 5 pears "
        "that cost 2 dollars each and gives 4 apples back to the friendly seller")
#: the same question with other numbers and another name
SAME = ITEM.replace("Alice", "Bob").replace("12", "40").replace("3 dollars", "7 dollars").replace("5 pears", "9 pears")
#: slots disagree: the item's one name becomes two
TORN = ITEM.replace("Alice buys", "Bob buys").replace("does Alice pay", "does Carol pay")


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, doc_id string, lang string")


def found(spark, texts, bench=None):
    b = items(spark, [(7, ITEM, "x", "y")] if bench is None else bench)
    return {r.doc_id: r for r in M.contamination(cases.plain(spark, texts), b).collect()}


def test_exact_reparameterised_and_clean(spark):
    rows = found(spark, ["So it began. " + ITEM + ". And so on.", "So it began. " + SAME + ". And so on.", cases.STORY, "", None, ITEM[:40]])
    assert [rows[i].contaminated for i in range(1, 7)] == [True, True, False, False, False, False]
    assert not rows[1].reparameterised and rows[2].reparameterised
    assert rows[1].coverage == 1.0 and rows[1].item_id == 7


def test_inconsistent_slots_are_no_hit_across_the_tear(spark):
    torn = M.leaks(cases.plain(spark, [TORN]), items(spark, [(7, ITEM, "x", "y")]), 0.0).collect()
    assert torn == []


def test_windows_of_placeholders_are_no_evidence(spark):
    bench = [(1, "1 2 3 4 5 6 7 8 9 10 11 12 13 14", "x", "y")]
    assert not found(spark, ["20 21 22 23 24 25 26 27 28 29 30 31 32 33"], bench)[1].contaminated


def test_awkward_items_and_rows(spark):
    bench = [(1, None, "x", "y"), (2, "", "x", "y"), (None, cases.OTHER, "x", "y"), (3, cases.OTHER, "x", "y"), (4, cases.OTHER, "x", "y"), (5, "one two three four", "a", "b")]
    df = cases.docs(spark)
    out = M.contamination(df, items(spark, bench)).collect()
    assert len(out) == df.count()
    hit = {r.doc_id: r.n_items for r in out if r.contaminated}
    assert set(hit) == {4, 12, 16, None} and hit[4] == 2
    kept = M.drop_contaminated(df, items(spark, bench))
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 4 not in ids and 16 not in ids and ids.count(None) == 2 and 1 in ids


def test_empty_tables(spark):
    assert M.contamination(cases.empty(spark), items(spark, [(7, ITEM, "x", "y")])).collect() == []
    assert not any(r.contaminated for r in M.contamination(cases.docs(spark), items(spark, [])).collect())


def test_shuffle_join_beyond_the_broadcast_bound_gives_the_same_rows(spark, monkeypatch):
    df, b = cases.plain(spark, ["Well. " + ITEM, SAME, cases.STORY]), items(spark, [(7, ITEM, "x", "y")])
    small = sorted(map(tuple, M.leaks(df, b).collect()))
    monkeypatch.setattr(M, "BROADCAST_WINDOWS", 3)
    assert sorted(map(tuple, M.leaks(df, b).collect())) == small and len(small) == 2


def test_short_items_are_found_inside_documents(spark):
    bench = [(1, "What is the capital of France?", "x", "y"), (2, "Name 3 rivers", "x", "y"), (3, "What is the capital of Norway", "x", "y")]
    rows = found(spark, ["And then they asked: what is the capital of France? Nobody knew the answer to that.",
                         "Please name 3 rivers that run through the old town and two that do not", "Please name 4 rivers of it", cases.STORY], bench)
    # the two questions about a capital are one template; too few ordinary words are left in "Name 4 rivers"
    assert [rows[i].n_items for i in range(1, 5)] == [2, 1, 0, 0]
    assert rows[1].contaminated and rows[1].coverage == 1.0 and rows[2].item_id == 2


#: one number twice
TWICE = ("The old mill grinds 5 sacks of corn in the morning and another 5 sacks of rye after noon while the miller and the "
         "young helper carry the full sacks over the bridge to the baker in the village below")


def test_copies_of_numbers_are_found(spark):
    bench = [(1, "1 2 3 4 5 6 7 8 9 10 12 14 16 18 kg", "x", "y")]
    rows = found(spark, ["So: 1 2 3 4 5 6 7 8 9 10 12 14 16 18 kg. Done", "So: 1 2 3 4 5 6 7 9 9 11 12 14 17 18 kg. Done"], bench)
    assert rows[1].contaminated and rows[1].coverage == 1.0 and not rows[1].reparameterised
    assert not rows[2].contaminated


def test_a_conflicting_slot_drops_its_windows_only(spark):
    bench = [(1, TWICE, "x", "y"), (2, TWICE.replace("grinds 5", "grinds 3"), "x", "y")]
    rows = M.leaks(cases.plain(spark, [TWICE.replace("another 5", "another 6")]), items(spark, bench[:1]), 0.0).collect()
    assert len(rows) == 1 and rows[0].coverage > 0.9
    rows = M.leaks(cases.plain(spark, [TWICE.replace("5 sacks", "4 sacks")]), items(spark, bench[1:]), 0.0).collect()
    assert len(rows) == 1 and 0.5 < rows[0].coverage < 1
    assert not rows[0].changed


def test_a_long_equal_run_of_a_long_item(spark):
    item = " ".join(f"thing{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    quote = lambda n: "So it went: " + " ".join(item.split()[100:100 + n]) + " and no more"
    rows = found(spark, [quote(120), quote(M.RUN_WORDS), quote(M.RUN_WORDS - 1)], [(1, item, "x", "y")])
    assert [rows[i].contaminated for i in (1, 2, 3)] == [True, True, False]
    assert rows[1].coverage == 0.4
