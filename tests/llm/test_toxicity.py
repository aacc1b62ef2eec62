import zlib

import numpy as np

from regionpanel.llm import textbytes as T
from regionpanel.llm import toxicity as M
from tests.conftest import SF_SMALL
from tests.llm import cases

SF = SF_SMALL.replace("sf0.001", "sf0.1")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int, quality int, text string")


def test_held_out_accuracy(spark):
    docs, lab = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = M.scores(docs, lab).join(lab.select("doc_id", "toxic"), "doc_id", "left").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(r.score, r.toxic) for r in rows if r.held_out and r.toxic is not None]
    pos, neg = [s for s, t in held if t], [s for s, t in held if not t]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.95
    assert np.mean([r.predicted for r in rows if r.toxic == 0]) < 0.03


def test_scores_ignore_source_language_and_id(spark):
    lab = labels(spark, [(i, int(i % 4 == 0), 1, "x") for i in range(1, 200)])
    texts = [("you stupid idiot " if i % 4 == 0 else "a kind word ") + cases.STORY for i in range(1, 200)]
    df = cases.plain(spark, texts)
    a = {r.doc_id: r.score for r in M.scores(df, lab).collect()}
    assert len({round(v, 9) for k, v in a.items() if k % 4 == 0}) == 1
    assert a[4] > 0.5 > a[5]


def test_held_out_labels_change_nothing(spark):
    rows = [(i, int(i % 4 == 0), 1, "x") for i in range(1, 200)]
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t, q, x) for i, t, q, x in rows]
    df = cases.plain(spark, [("scum and trash " if i % 4 == 0 else "fine and good ") + cases.OTHER for i in range(1, 200)])
    one, two = ({r.doc_id: r.score for r in M.scores(df, labels(spark, x)).collect()} for x in (rows, flipped))
    assert one == two


def test_awkward_rows_and_degenerate_labels(spark):
    df = cases.docs(spark)
    for rows in ([], [(1, 1, 1, "x")], [(None, 1, 1, "x"), (2, None, 1, "x"), (3, 0, 1, "x")]):
        out = M.scores(df, labels(spark, rows)).collect()
        assert len(out) == df.count() and all(0 <= r.score <= 1 for r in out)
        assert [r.held_out for r in out if r.doc_id is None] == [False, False]
    assert M.scores(cases.empty(spark), labels(spark, [])).collect() == []
    assert M.drop_toxic(df, labels(spark, [(3, 0, 1, "x")])).columns == df.columns


def test_features_by_hand():
    raw = ["You idiot!! st*pid 1d10t", "", "GOOD day aaa"]
    data = "".join(raw).encode()
    offsets = np.cumsum([0] + [len(x) for x in raw])
    none = ((np.zeros(0, np.uint64), np.zeros(0)),) * 2
    rows = dict(zip(M.FEATURES, M.feature_rows(np.frombuffer(data, np.uint8), offsets, *none).T))
    assert rows["insult_count"][0] == np.log1p(1) and rows["near_second_person"][0] > 0
    assert rows["obfuscated"][0] > 0 and rows["symbols_inside"][0] > 0
    assert (np.array([v[1] for v in rows.values()]) == 0).all()
    assert rows["capitals"][2] == 4 / 10 and rows["repeats"][2] > 0
    assert T.SLICE_BYTES
