import hashlib
import math
import re
from zlib import crc32

import pytest

from regionpanel.llm import resampling as M
from tests.llm import cases


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def grams(text, n):
    w = words(text)
    return [crc32(" ".join(w[i:i + k]).encode()) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, n, buckets, percent, least):
    f = [[g % buckets for g in grams(t, n)] for _, t in docs]
    t = [g % buckets for x in target for g in grams(x, n)]
    every = [b for x in f for b in x]
    gain = {b: math.floor(1000 * math.log((t.count(b) + 1) * (len(every) + buckets) / ((every.count(b) + 1) * (len(t) + buckets))))
            for b in set(every)}
    out = []
    for (doc, text), x in zip(docs, f):
        weight = math.floor(sum(gain[b] for b in x) / len(x)) if x else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(words(text)), len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), None])
    can = sorted([r for r in out if r[1] >= least], key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, r in enumerate(can[:len(can) * percent // 100], 1):
        r[5] = rank
    return out


def same(got, want):
    plain = lambda rows: sorted([tuple(r)[:5] for r in rows], key=repr)
    assert plain(got) == plain(want)
    # equal rows may change places
    ranks = lambda rows: sorted((r[5], r[4], r[0]) for r in rows if r[5] is not None)
    assert ranks(map(tuple, got)) == ranks(want)


@pytest.mark.parametrize("n,percent,least", [(1, 10, 20), (3, 50, 1), (2, 100, 0), (1, 0, 0)])
def test_awkward_rows(spark, n, percent, least):
    df = cases.docs(spark)
    target = spark.createDataFrame([(cases.STORY,), (None,), ("",), ("Ünïcode one",)], "text string")
    got = M.resample(df, target, n, 97, percent, least).collect()
    same(got, brute([(r.doc_id, r.text) for r in df.collect()], [r.text for r in target.collect()], n, 97, percent, least))


def test_many_parts_keep_the_order(spark):
    texts = [" ".join(f"w{(i * j) % 71}" for j in range(25 + i % 7)) for i in range(500)]
    target = spark.createDataFrame([("w1 w2 w3 w5 w8 w13",)], "text string")
    got = M.resample(cases.plain(spark, texts).repartition(13), target, 1, 1000, 30, 20).collect()
    same(got, brute(list(enumerate(texts, 1)), ["w1 w2 w3 w5 w8 w13"], 1, 1000, 30, 20))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert M.resample(cases.empty(spark), none).collect() == []
    rows = M.resample(cases.plain(spark, [cases.STORY, "x"]), none).collect()
    assert len(rows) == 2 and all(r["rank"] is None for r in rows)


def test_chained_checksums_are_those_of_the_joined_words():
    text = "Alpha beta-gamma 12 \u00fcber"
    got = M.features(M.words_of(text.encode()), 3, 1 << 32)
    assert got == grams(text, 3)
