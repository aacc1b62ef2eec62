import hashlib

import numpy as np

from regionpanel.llm import fingerprints as M
from tests.llm import cases


def run(df):
    return M.chained_fingerprints(df).collect()


def test_edited_texts_and_order(spark):
    texts = ["alpha beta gamma", "", None, "x", cases.STORY, cases.OTHER, cases.STORY]
    rows = {r.doc_id: r for r in run(cases.plain(spark, texts).repartition(5))}
    ordered = [(i, t or "") for i, t in reversed(list(enumerate(texts, 1)))]
    for at, (i, t) in enumerate(ordered):
        nxt = ordered[(at + 1) % len(ordered)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        assert rows[i].n_chars == len(t)
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
    assert rows[5].fingerprint == rows[7].fingerprint != rows[6].fingerprint
    assert rows[2].fingerprint == rows[3].fingerprint == ""
    assert rows[2].near_edited == 1.0


def test_awkward_rows_are_all_there(spark):
    df = cases.docs(spark)
    rows = run(df)
    assert len(rows) == df.count()
    by_text = {}
    for r in rows:
        by_text.setdefault((r.n_chars, r.doc_id), set()).add(r.fingerprint)
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 2)}) == 1


def test_single_row_and_empty_table(spark):
    one = run(cases.plain(spark, ["abcdef"]))
    assert one[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    assert run(cases.empty(spark)) == []


def test_likeness_follows_jaccard():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.9):
        common = [f"c{i}" for i in range(int(1500 * share))]
        a, b = ([f"{p}{i}" for i in range(1500 - len(common))] for p in "ab")
        texts = [" ".join(common + x).encode() for x in (a, b)]
        fp, has = M.fingerprint_matrix(*M._join_texts(texts), 1)
        true = len(common) / (3000 - len(common))
        assert abs(M.likeness(fp[:1], fp[1:], has[:1], has[1:])[0] - true) < 0.12
    assert rng is not None


def test_densification_fills_every_bin_alike():
    fp, has = M.fingerprint_matrix(*M._join_texts([b"a b c d e f g", b"a b c d e f g"]), 5)
    assert has.all() and (fp[0] == fp[1]).all()
