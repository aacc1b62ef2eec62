import random
import re

import numpy as np
import pytest

from regionpanel.llm import minhash_hamming as M
from tests.llm import cases


def shingle_set(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return set(zip(*[w[i:] for i in range(k)])) if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k):
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            linked = (rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j]
                      and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
            if linked or same_id and sets[i] and sets[i] == sets[j]:
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        comp = min(ids) if ids and doc is not None else doc
        out.append((doc, len(sets[i]), comp, doc is None or doc == comp))
    return sorted(out, key=repr)


def run(df, k):
    return sorted([tuple(r) for r in M.near_duplicates(df, k).collect()], key=repr)


@pytest.mark.parametrize("k", [2, 5])
def test_awkward_rows(spark, k):
    df = cases.docs(spark)
    assert run(df, k) == brute([(r.doc_id, r.text) for r in df.collect()], k)


def test_edited_copies(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocab) for _ in range(150)]
    texts = []
    for i in range(120):
        words = [rng.choice(vocab) if rng.random() < 0.001 * (i % 90) else w for w in base]
        texts.append(" ".join(words))
    texts += [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 100))) for _ in range(60)]
    assert run(cases.plain(spark, texts), 2) == brute(list(enumerate(texts, 1)), 2)


def test_small_blocks_and_no_random_rounds_give_the_same(spark, monkeypatch):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocab) for _ in range(80)]
    texts = [" ".join(rng.choice(vocab) if rng.random() < 0.12 else w for w in base) for _ in range(90)]
    monkeypatch.setattr(M, "ROUNDS", 0)
    monkeypatch.setattr(M, "BLOCK", 7)
    assert run(cases.plain(spark, texts), 2) == brute(list(enumerate(texts, 1)), 2)


def test_chain_reaches_the_smallest_id(spark):
    words = [f"w{i}" for i in range(140)]
    texts = [" ".join(words[i * 4:i * 4 + 60]) for i in range(20)][::-1]  # neighbours share 56 of 60 words
    got = {r.doc_id: r.component_id for r in M.near_duplicates(cases.plain(spark, texts), 2).collect()}
    assert set(got.values()) == {1}


def test_empty_table(spark):
    assert run(cases.empty(spark), 2) == []


def test_pigeonhole_keys_meet_within_the_radius():
    rng = np.random.default_rng(5)
    import pyarrow as pa
    a = rng.integers(0, 256, M.SYMBOLS).astype(np.uint8)
    for _ in range(50):
        b = a.copy()
        at = rng.choice(M.SYMBOLS, M.RADIUS, replace=False)
        b[at] = b[at] + rng.integers(1, 256, M.RADIUS).astype(np.uint8)
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([a.tobytes(), b.tobytes()], pa.binary())], names=["id", "sig"])
        keys = np.concatenate([x.column(0).to_numpy() for x in M._keys([batch])]).reshape(2, -1)
        assert set(keys[0]) & set(keys[1])


def test_dropping_keeps_one_of_a_group(spark):
    out = M.drop_near_duplicates(cases.docs(spark), 5)
    ids = [r.doc_id for r in out.collect()]
    assert 1 in ids and 2 not in ids and ids.count(None) == 2
    assert set(out.columns) == set(cases.docs(spark).columns)


def near_group(n, seed=0):
    """A group of near copies around the threshold: many keys hold several components."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    base = [rng.choice(vocab) for _ in range(100)]
    return [" ".join(rng.choice(vocab) if rng.random() < 0.07 else w for w in base) for _ in range(n)]


@pytest.mark.parametrize("block,size", [(1000, 32 << 20), (9, 32 << 20), (1000, 20_000)])
def test_stragglers_against_their_zone(spark, monkeypatch, block, size):
    monkeypatch.setattr(M, "ROUNDS", 1)
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "BLOCK_BYTES", size)
    texts = near_group(70) + near_group(40, 1)
    assert run(cases.plain(spark, texts), 2) == brute(list(enumerate(texts, 1)), 2)


def test_rows_follow_the_group_not_its_square(spark, monkeypatch):
    rows, cells = [], M._zone_cells
    links, staged = [], M.staged

    def counting(mixed, classes):
        out = cells(mixed, classes)
        rows.append(out.count())
        return out

    def watching(df, name):
        out = staged(df, name)
        if name in ("near-pairs", "last-links"):
            links.append(out.count())
        return out

    monkeypatch.setattr(M, "_zone_cells", counting)
    monkeypatch.setattr(M, "staged", watching)
    made = []
    for n in (150, 300):
        rows.clear(), links.clear()
        M.near_duplicates(cases.plain(spark, near_group(n)), 2).collect()
        made.append((sum(rows), sum(links)))
    (r1, l1), (r2, l2) = made
    assert r2 <= 2.6 * r1 + 50 and l2 <= 2.6 * l1 + 50 and r2 <= 3 * 300 and l2 <= 9 * 300


def test_recall_at_the_threshold(spark):
    """Every pair at 0.8 or more similarity, found by all pairs of sets, is in one component."""
    texts = near_group(250, 3)
    sets = [shingle_set(t, 2) for t in texts]
    component = {r.doc_id: r.component_id for r in M.near_duplicates(cases.plain(spark, texts), 2).collect()}
    pairs = [(i, j) for i in range(250) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert len(pairs) > 200 and all(component[i + 1] == component[j + 1] for i, j in pairs)
