"""Connected components of a table of links, by contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, staged


class Labels:
    """Smallest reachable position of each position, by vectorised minimum and pointer jumping."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.of[a], self.of[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.of, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.of[self.of]
                if (up == self.of).all():
                    break
                self.of = up


def _forest(batches):
    """The links of a task as stars: each vertex with the smallest one that the task's links join it to."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        x, y = (np.concatenate(c) for c in zip(*held))
        names, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        labels = Labels(len(names))
        labels.link(at[:len(x)], at[len(x):])
        away = np.flatnonzero(labels.of != np.arange(len(names)))
        if len(away):
            yield pa.RecordBatch.from_arrays([pa.array(names[labels.of[away]]), pa.array(names[away])], names=["x", "y"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in ``edges`` (a, b).

    Each round a task first turns the links it holds into stars (a map-side
    combine: at most one link per vertex leaves it); then every vertex moves to
    the neighbour of smallest hash (xxhash64 of one long is a permutation, so
    vertices stay apart), edges follow and loops vanish.  The neighbour minimum
    combines map-side, so a hub with a third of all edges is no hot group.
    Random priorities keep the rounds logarithmic on chains as well."""
    edges = edges.select(F.xxhash64("a").alias("x"), F.xxhash64("b").alias("y"), "a", "b")
    names = staged(edges.select(F.explode(F.array(F.struct("x", F.col("a").alias("id")), F.struct(F.col("y").alias("x"), F.col("b").alias("id")))).alias("v"))
                   .select("v.x", "v.id").distinct(), "vertices")
    moves = []
    rest = staged(edges.select("x", "y").mapInArrow(_forest, "x long, y long"), "edges")
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("y").alias("x"), F.col("x").alias("y")))
        move = staged(both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("to")), "moves")
        following = staged(
            rest.join(move.withColumnRenamed("to", "tx"), "x")
            .join(move.select(F.col("x").alias("y"), F.col("to").alias("ty")), "y")
            .select(F.col("tx").alias("x"), F.col("ty").alias("y")).where("x <> y").mapInArrow(_forest, "x long, y long"), "edges")
        moves.append(move)
        release(rest)
        rest = following
    root = names.select("id", F.col("x").alias("root"))
    for move in moves:
        root = root.join(move.withColumnRenamed("x", "root"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    root = staged(root, "roots")
    release(rest, names, *moves)
    least = root.groupBy("root").agg(F.min("id").alias("component"))
    return root.join(least, "root").select("id", "component")


def joined_components(found: DataFrame, more: DataFrame) -> DataFrame:
    """(id, component) after links (a, b) are added: only they are contracted, between
    the components there are; an id that ``found`` does not have is its own."""
    ends = more.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    every = staged(found.unionByName(ends.join(found, "id", "left_anti").select("id", F.col("id").alias("component"))), "every")
    edges = staged(more.join(every.select(F.col("id").alias("a"), F.col("component").alias("x")), "a")
                   .join(every.select(F.col("id").alias("b"), F.col("component").alias("y")), "b")
                   .select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct(), "between")
    moved = components(edges).select(F.col("id").alias("component"), F.col("component").alias("root"))
    out = staged(every.join(moved, "component", "left").select("id", F.coalesce("root", "component").alias("component")), "found")
    release(every, edges)
    return out
