import hashlib
import random

import pytest

from regionpanel.llm import suffix_dedup
from tests.llm import cases


def brute(rows, length):
    last = 1 << 63
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            first[w] = min(first.get(w, last), last - 1 if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s:s + length]] < (last - 1 if i is None else i):
                gone[s:s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for j in range(len(b)) if gone[j] and (not j or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(df, length):
    return sorted([tuple(r) for r in suffix_dedup.removal_digest(df, length).collect()], key=repr)


def test_awkward_rows(spark):
    df = cases.docs(spark)
    assert run(df, 50) == brute([(r.doc_id, r.text) for r in df.collect()], 50)


@pytest.mark.parametrize("length", [20, 50, 100])
def test_random_repeats(spark, length):
    rng = random.Random(length)
    words = ["aa", "b", "ccc", "é", "the ", "of "]
    pool = ["".join(rng.choice(words) for _ in range(rng.randrange(5, 80))) for _ in range(12)]
    texts = ["".join(rng.choice(pool) if rng.random() < 0.5 else "".join(rng.choice(words) for _ in range(rng.randrange(60)))
                     for _ in range(rng.randrange(0, 6))) for _ in range(60)]
    df = cases.plain(spark, texts)
    assert run(df, length) == brute(list(enumerate(texts, 1)), length)


def test_runs_of_one_character(spark):
    texts = ["a" * 500, "a" * 500, "b" + "a" * 49, "a" * 49, "ab" * 200, "ba" * 200]
    assert run(cases.plain(spark, texts), 50) == brute(list(enumerate(texts, 1)), 50)


def test_large_task_count(spark):
    texts = [cases.STORY + f" {i}" for i in range(50)]
    df = cases.plain(spark, texts).repartition(17)
    assert run(df, 50) == brute(list(enumerate(texts, 1)), 50)


def test_empty_table(spark):
    assert run(cases.empty(spark), 50) == []


def test_cut_texts_keep_columns_and_whole_characters(spark):
    passage = "é" * 80
    df = cases.plain(spark, ["x" + passage + "y", "z" + passage + "w", None, "short"])
    out = {r.doc_id: r for r in suffix_dedup.remove_repeats(df, 50).collect()}
    assert suffix_dedup.remove_repeats(df, 50).columns == df.columns
    assert out[1].text == "x" + passage + "y"
    assert out[2].text == "zw" and out[2].n_chars == 2
    assert out[4].text == "short" and out[3].n_chars == 0


def test_one_long_run_is_one_record():
    import numpy as np
    text = np.frombuffer(b"a" * 200_000 + b"xy" * 50_000, np.uint8)
    rec, _ = suffix_dedup.parse(text, np.array([0, len(text)]), 50)
    assert len(rec) < 200
    ends = np.sort(suffix_dedup.last_start(rec))
    assert ends[-1] == len(text) - 50 and (np.sort(rec["a"])[1:] == ends[:-1] + 1).all()


def test_long_equal_runs(spark):
    rng = random.Random(1)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = ["q" * 5000, noise(80) + "q" * 3000 + noise(80), "xyz" * 900 + noise(30), noise(70) + "yzx" * 500, noise(200), "q" * 60 + "xyz" * 25]
    assert run(cases.plain(spark, texts), 50) == brute(list(enumerate(texts, 1)), 50)


def test_a_run_at_real_size(spark):
    rows = {r.doc_id: r for r in suffix_dedup.removal_digest(cases.plain(spark, ["a" * 400_000, "b" + "a" * 400_000 + "c"]), 50).collect()}
    assert (rows[1].n_removed, rows[2].n_removed, rows[2].n_spans) == (0, 400_000, 1)


@pytest.mark.parametrize("hot", [50_000, 3])
def test_shared_cores_with_different_ends(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = noise(70)
    texts = [noise(rng.randrange(40)) + passage[rng.randrange(9):70 - rng.randrange(9)] + noise(rng.randrange(40)) for _ in range(60)]
    assert run(cases.plain(spark, texts), 50) == brute(list(enumerate(texts, 1)), 50)


def test_rows_do_not_follow_the_number_of_tasks(spark, monkeypatch):
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = noise(90)
    texts = [noise(60) + passage + noise(60) for _ in range(120)]
    monkeypatch.setattr(suffix_dedup, "SEEN", 1)  # every third is sent
    counts, staged = [], suffix_dedup.staged

    def counting(df, name):
        out = staged(df, name)
        if name == "window-flags":
            counts.append(out.count())
        return out

    monkeypatch.setattr(suffix_dedup, "staged", counting)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = brute(list(enumerate(texts, 1)), 50)
    try:
        for n in ("4", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert run(cases.plain(spark, texts), 50) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert counts[1] <= 3 * counts[0] and max(counts) <= 8 * len(texts)


def test_suffix_order_is_that_of_the_bytes():
    import numpy as np
    rng = np.random.default_rng(2)
    body = rng.choice(np.frombuffer(b"\x00ab\xff", np.uint8), 300)
    starts, k = np.arange(280), rng.integers(0, 5, 280)
    order, marks = suffix_dedup.suffix_order(body, starts, 11, k)
    keys = [(body[s:s + 11].tobytes(), k[s]) for s in starts]
    assert [keys[i] for i in order] == sorted(keys)
    least = {}
    for w, d in keys:
        least[w] = min(d, least.get(w, d))
    assert marks.tolist() == [keys[i][1] > least[keys[i][0]] for i in order]
