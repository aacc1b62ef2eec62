"""Near-duplicates by SimHash: fingerprints in a sharded vantage-point tree.

1. **Fingerprints.**  Every 3-word shingle (repeats included) is hashed with
   XXH64 (seed 42); a bit of the fingerprint is set if it is set in over half of
   the hashes.  One pass over the texts; equal fingerprints collapse at once.
2. **Top tree.**  A vantage-point tree is grown on the driver over at most
   ``SAMPLE`` fingerprints (drawn by their hash; with fewer in all, all of them)
   until a leaf stands for about ``leaf`` fingerprints.  A node holds a vantage
   point and a radius that split well with few points near the border.
3. **Overlapping shards.**  By the triangle inequality two fingerprints within
   ``RADIUS`` bits lie at most ``RADIUS`` apart in distance from any vantage
   point.  The inside of a node therefore also takes every point up to
   ``RADIUS`` beyond its border; the outside keeps what lies beyond the border
   (or the other way round, whichever copies fewer).  So every linked pair is
   whole in at least one child, and by induction in at least one leaf: the
   others are pruned.  A leaf is a shard; a fingerprint goes to each shard that
   its paths end in.
4. **Exact pairs.**  A task goes on with the same splits inside its shard until
   blocks are small and compares those bit by bit.  It keeps one label per
   fingerprint and sends one link per fingerprint that is not the smallest of
   its local component: a group of thousands of near copies gives as many
   links, never its square, and no component is lost.
5. Components of those links by contraction; documents get theirs by fingerprint.

The sample only shapes the tree; every fingerprint is placed and searched, and
the result does not depend on it.

Null or empty text: fingerprint zero, linked like any other.  Fewer than three
words: the whole sequence is one shingle.  A document without id is a document
of its component, whose id is the smallest there is (null if there is none).
Rows that share an id or a text are rows of their own.  An empty table gives an
empty result; extra columns are never read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, python_batches, staged
from .components import Labels, components

SHINGLE_WORDS = 3
RADIUS = 3
#: fingerprints that shape the top tree, at most about
SAMPLE = 1 << 17
#: smallest and largest number of fingerprints a leaf of the top tree is planned for
LEAF_LEAST, LEAF_MOST = 1 << 15, 1 << 20
#: a block of so many is compared bit by bit
BLOCK = 512
#: distances in one slab of a comparison
SLAB = 1 << 21
#: a split that copies more bits for each bit it tells does not pay; share of its points that a child may hold
WORST, LARGEST_CHILD = 0.6, 0.87

_U = np.uint64


# ------------------------------------------------------------------ fingerprints

def shingle_hashes(text: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of every run of ``words`` words, joined by a space (fewer words: of all of them)."""
    found = text.lower().split()  # of bytes: A-Z only, the six ASCII white-space characters only
    if not found:
        return np.zeros(0, _U)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], _U)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[:len(found) - words + 1].tolist()
    digest, ends = xxhash.xxh64_intdigest, ends[words - 1:].tolist()
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends)], _U)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes; zero without any."""
    set_ = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8")
        set_ += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * set_ > len(hashes)).tolist())


def _fingerprints(words: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            prints = [fingerprint(shingle_hashes(x.as_py() or b"", words)) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, _U).astype(np.int64))], names=["doc_id", "f"])
    return run


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``f``, the fingerprint's 64 bits as a long, for every row."""
    python_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _fingerprints(words), "doc_id long, f long")


# ------------------------------------------------------------------ vantage-point splits

def _distance(points: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ to)


def split_of(points: np.ndarray, radius: int = RADIUS, tries: int = 6, looked: int = 2048):
    """(vantage, border, inner): the split that copies least for what it tells, or None.

    ``inner`` says whether the inside takes the points up to ``radius`` beyond
    the border (else the outside takes those up to ``radius`` within it).
    Vantage points are judged on ``looked`` evenly spaced points; no child may
    hold more than ``LARGEST_CHILD`` of them.
    """
    some = points[::max(1, len(points) // looked)]
    n = len(some)
    border = np.arange(64)
    best, least = None, WORST
    for v in some[::max(1, n // tries)][:tries]:
        upto = np.cumsum(np.bincount(_distance(some, v), minlength=65 + radius))[:65 + radius] / n
        inside, wider = upto[border], upto[border + radius]
        closer = np.where(border >= radius, upto[border - radius], 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            told = -(inside * np.log2(inside) + (1 - inside) * np.log2(1 - inside))
            for inner, copied, largest in ((True, wider - inside, np.maximum(wider, 1 - inside)),
                                           (False, inside - closer, np.maximum(inside, 1 - closer))):
                cost = np.where(largest <= LARGEST_CHILD, np.log2(1 + copied) / told, np.inf)
                at = int(np.argmin(cost))
                if cost[at] < least:
                    best, least = (int(v), at, inner), float(cost[at])
    return best


def sides(points: np.ndarray, split, radius: int = RADIUS):
    """Masks of the inside and the outside; every pair within ``radius`` is whole in one."""
    vantage, border, inner = split
    d = _distance(points, _U(vantage))
    return d <= border + (radius if inner else 0), d > border - (0 if inner else radius)


def split_rows(points: np.ndarray, radius: int = RADIUS):
    """(split, masks of its two sides), or two Nones where no split makes the points fewer."""
    split = split_of(points, radius)
    masks = sides(points, split, radius) if split is not None else None
    return (split, masks) if masks and max(m.sum() for m in masks) < 0.95 * len(points) else (None, None)


def grow(points: np.ndarray, leaf: float, radius: int = RADIUS) -> list:
    """Nodes (vantage, border, inner, inside, outside); a child below zero is leaf -1 - child."""
    nodes, leaves, todo = [], 0, [(points, None, 0)]
    while todo:
        part, parent, side = todo.pop()
        split, masks = split_rows(part, radius) if len(part) > max(leaf, 64) else (None, None)
        if split is None:
            here, leaves = -1 - leaves, leaves + 1
        else:
            here = len(nodes)
            nodes.append([*split, 0, 0])
            todo += [(part[mask], here, side) for mask, side in zip(masks, (3, 4))]
        if parent is not None:
            nodes[parent][side] = here
    return nodes


def shards_of(points: np.ndarray, nodes: list, radius: int = RADIUS):
    """(shard, index): every leaf that each point's paths end in."""
    todo, out = [(0 if nodes else -1, np.arange(len(points)))], []
    while todo:
        at, rows = todo.pop()
        if not len(rows):
            continue
        if at < 0:
            out.append((-1 - at, rows))
            continue
        for child, mask in zip(nodes[at][3:], sides(points[rows], nodes[at][:3], radius)):
            todo.append((child, rows[mask]))
    return out


def local_links(points: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For distinct points: the position of the smallest position in reach of each over links within ``radius`` bits."""
    labels = Labels(len(points))
    todo = [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        part = points[rows]
        split, masks = split_rows(part, radius) if len(rows) > BLOCK else (None, None)
        if split is not None:
            todo += [rows[mask] for mask in masks]
            continue
        step = max(1, SLAB // max(1, len(rows)))
        for at in range(0, len(rows), step):
            x, y = np.nonzero(np.bitwise_count(part[at:at + step, None] ^ part[None, at:]) <= radius)
            apart = x < y
            labels.link(rows[x[apart] + at], rows[y[apart] + at])
    return labels.of


# ------------------------------------------------------------------ Spark

def _place(nodes, radius: int):
    def run(batches):
        tree = nodes.value
        for batch in batches:
            points = batch.column(0).to_numpy().view(_U)
            for shard, rows in shards_of(points, tree, radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), shard, np.int32)), pa.array(points[rows].view(np.int64))], names=["shard", "f"])
    return run


def _search(radius: int):
    def links(held):
        points = np.concatenate(held).view(_U)
        root = local_links(points, radius)
        away = np.flatnonzero(root != np.arange(len(points)))
        if len(away):
            yield pa.RecordBatch.from_arrays([pa.array(points[root[away]].view(np.int64)), pa.array(points[away].view(np.int64))], names=["a", "b"])

    def run(batches):
        at, held = None, []
        for batch in batches:
            shard, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])).tolist() + [len(shard)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if shard[lo] != at and held:
                    yield from links(held)
                    held = []
                at = shard[lo]
                held.append(f[lo:hi].copy())
        if held:
            yield from links(held)
    return run


def links(points: DataFrame, radius: int = RADIUS, leaf: int | None = None) -> DataFrame:
    """(a, b): links that join all components of the distinct longs ``f`` within ``radius`` bits."""
    spark = points.sparkSession
    n = points.count()
    leaf = leaf or min(LEAF_MOST, max(LEAF_LEAST, n // (4 * partitions(spark))))
    drawn = points
    if n > SAMPLE:  # a share by hash: about SAMPLE rows, the same in every run
        drawn = points.where(F.xxhash64("f", F.lit("sample")) < int((2 * SAMPLE / n - 1) * (1 << 63)))
    some = np.sort(np.array([r.f for r in drawn.collect()], np.int64)).view(_U)
    some = np.random.default_rng(5).permutation(some)
    nodes = spark.sparkContext.broadcast(grow(some, leaf * min(1.0, len(some) / max(n, 1)), radius))
    # the table may lie in few files: its rows are dealt out, eight bytes each, before each goes to several shards
    return (points.select("f").repartition(partitions(spark)).mapInArrow(_place(nodes, radius), "shard int, f long")
            .repartition(partitions(spark), "shard").sortWithinPartitions("shard").mapInArrow(_search(radius), "a long, b long"))


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS, id_col: str = "doc_id",
                    text_col: str = "text", leaf: int | None = None) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, n_docs of its component."""
    prints = staged(fingerprints(docs, words, id_col, text_col), "prints")
    points = staged(prints.groupBy("f").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "points")
    found = staged(components(staged(links(points, radius, leaf), "print-links")).select(F.col("id").alias("f"), "component"), "print-components")
    placed = points.join(found, "f", "left").select("f", "least", "n", F.coalesce("component", "f").alias("c"))
    whole = placed.groupBy("c").agg(F.min("least").alias("component_id"), F.sum("n").alias("n_docs"))
    of = placed.select("f", "c").join(whole, "c").select("f", "component_id", "n_docs")
    return prints.join(of, "f").select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id", "n_docs")
