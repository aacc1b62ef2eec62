import random

import numpy as np
import pytest
import xxhash

from regionpanel.llm import simhash_vptree as M
from tests.llm import cases


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()
    for c in b"\t\n\x0b\x0c\r":
        words = words.replace(bytes([c]), b" ")
    words = [w for w in words.split(b" ") if w]
    runs = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(r, seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [slow_fingerprint(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3 and comp[i] != comp[j]:
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    out = []
    for (doc, _), f, c in zip(rows, prints, comp):
        ids = [d for (d, _), x in zip(rows, comp) if x == c and d is not None]
        out.append((doc, f"{f:016x}", min(ids) if ids else None, comp.count(c)))
    return sorted(out, key=repr)


def run(df, **more):
    return sorted([tuple(r) for r in M.near_duplicates(df, **more).collect()], key=repr)


def test_awkward_rows(spark):
    df = cases.docs(spark)
    assert run(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_edited_copies_over_small_shards(spark, monkeypatch):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(500)]
    base = [rng.choice(vocab) for _ in range(400)]
    texts = []
    for i in range(150):
        at = rng.randrange(390)
        texts.append(" ".join(base[:at] + [rng.choice(vocab) for _ in range(i % 6)] + base[at + i % 6:]))
    texts += [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    monkeypatch.setattr(M, "BLOCK", 16)
    assert run(cases.plain(spark, texts), leaf=40) == brute(list(enumerate(texts, 1)))


def test_a_sample_shapes_the_tree_only(spark, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    monkeypatch.setattr(M, "SAMPLE", 150)
    assert run(cases.plain(spark, texts), leaf=30) == brute(list(enumerate(texts, 1)))


def near_pairs(points):
    x, y = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= M.RADIUS)
    return {(a, b) for a, b in zip(x.tolist(), y.tolist()) if a < b}


@pytest.mark.parametrize("seed", range(4))
def test_every_linked_pair_is_whole_in_a_shard(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.int64).astype(np.uint64)
    points = centres[rng.integers(0, 40, 3000)]
    for _ in range(int(rng.integers(2, 9))):
        points = points ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64))
    points = np.unique(points)
    nodes = M.grow(rng.permutation(points)[:1000], 60)
    together = set()
    for _, rows in M.shards_of(points, nodes):
        together |= {tuple(sorted((int(rows[a]), int(rows[b])))) for a, b in near_pairs(points[rows])}
    assert together == near_pairs(points)
    labels = M.Labels(len(points))
    pairs = np.array(sorted(near_pairs(points)), int).reshape(-1, 2)
    labels.link(pairs[:, 0], pairs[:, 1])
    assert (M.local_links(points) == labels.of).all()


def test_links_of_a_group_grow_with_its_size_not_its_square():
    rng = np.random.default_rng(1)
    made = []
    for n in (2000, 4000):
        points = np.unique(rng.integers(0, 1 << 14, n).astype(np.uint64))
        made.append((len(points), sum(b.num_rows for b in M._search(M.RADIUS)(iter([_batch(points)])))))
    for n, rows in made:
        assert rows < n


def _batch(points):
    import pyarrow as pa
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(points), np.int32)), pa.array(points.view(np.int64))], names=["shard", "f"])


def test_empty_table_and_long_text(spark):
    assert run(cases.empty(spark)) == []
    long = " ".join(f"w{i % 977}" for i in range(150_000))
    (row,) = run(cases.plain(spark, [long]))
    assert row == (1, f"{slow_fingerprint(long):016x}", 1, 1)


def test_the_hash_is_that_of_spark(spark):
    words = "alpha beta gamma"
    (row,) = spark.sql(f"SELECT xxhash64('{words}') AS h").collect()
    assert int(M.shingle_hashes(words.upper().encode()).view(np.int64)[0]) == row.h
