"""Near-duplicate documents: b-bit MinHash signatures and a multi-index Hamming join.

A document is the set of its distinct ``k``-word shingles.  Its signature holds
``SYMBOLS`` MinHash values of 8 bits.  Two sets of Jaccard similarity s differ
in about (1 - s) of their symbols.  A short signature makes the keys; documents
that meet another one get a long one of ``LONG`` symbols, in which pairs at the
link threshold stay within ``REACH`` differing symbols but for a chance of a
few in 100,000 at exactly the threshold (far less above it).

1. Documents with equal sets are one class (a shuffle with map-side combine);
   only class representatives go on.
2. **Multi-index join.**  A signature is cut into ``CHUNKS`` chunks.  By the
   pigeonhole principle two signatures at most ``RADIUS`` = 2 * CHUNKS - 1
   apart differ in at most 1 symbol of some chunk.  Each chunk gives one key
   for each symbol that may differ (the chunk without that symbol), so every
   pair within the radius meets under a key: none is lost.  Pairs further
   apart meet unless every chunk has two errors; at similarity 0.8 that is a
   chance of 3 in 100,000.  Six symbols of a key keep unrelated texts apart
   at any corpus size in sight.
3. Keys of two members give their pair.  The members of larger keys stand in a
   random order in each of ``ROUNDS`` rounds, and a document is compared with
   its next neighbour of another component in two of its keys.  Signature distance first (``REACH``), then
   links are confirmed on the full sets with 100 * intersection >= 80 * union.
   A round compares two pairs a document, however large its group.
4. **What is left.**  Members of keys that still hold several components form
   *zones* (chains of shared keys).  In a zone only *stragglers* - all but the
   members of its largest component - can have missed a link, so stragglers are
   held against all members, in cells of at most ``BLOCK`` rows or
   ``BLOCK_BYTES`` bytes a side, dealt out by zone and block pair: a row travels
   once for each block of the other side, not once for each key.  A task tests
   shared key, long signature and full sets in turn, skips pairs that are joined
   already and sends one link for each component it joins: no row is made for a
   pair, so a group of thousands of near copies makes rows in proportion to its
   size, and no component is lost.
5. Components by contraction with hashed priorities (a few joins, each round
   written to the shared folder).

Null or empty text: no shingles, linked with nothing.  Fewer than ``k`` words:
the whole sequence is one shingle.  Rows that share an id are one vertex.  A
null id is linked with nothing, has a null component and is kept.  An empty
table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textbytes as T
from .common import partitions, python_batches, release, staged
from .components import components, joined_components

CHUNKS = 12
SYMBOLS = 7 * CHUNKS
RADIUS = 2 * CHUNKS - 1
LONG = 800
REACH = 204
BLOCK = 1000
#: bytes of one side of a cell, signatures and sets
BLOCK_BYTES = 32 << 20
ROUNDS = 3
SALTS = 8
#: first symbol of each chunk
BORDERS = [SYMBOLS * i // CHUNKS for i in range(CHUNKS + 1)]

_U = np.uint64
_rng = np.random.default_rng(71)
_XOR = _rng.integers(0, 1 << 63, LONG, dtype=np.int64).astype(np.uint64)
_MUL = _rng.integers(0, 1 << 62, LONG, dtype=np.int64).astype(np.uint64) * _U(2) + _U(1)


def signatures(value: np.ndarray, cuts: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    """(documents, symbols) bytes; rows of documents without shingles are zero."""
    n = len(cuts) - 1
    out = np.zeros((n, symbols), np.uint8)
    full = np.flatnonzero(np.diff(cuts) > 0)
    if len(full):
        for s in range(symbols):
            smallest = np.minimum.reduceat((value ^ _XOR[s]) * _MUL[s], cuts[full])
            out[full, s] = (T.mix(smallest) >> _U(56)).astype(np.uint8)
    return out


def _blobs(flat: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32).tobytes()),
                                                              pa.py_buffer(np.ascontiguousarray(flat).tobytes())])


def _sets_of(batch: pa.RecordBatch, k: int):
    """Per slice: (row range, distinct shingle hashes, their cuts)."""
    data, offsets = T.text_column(batch)
    for i, j in T.slices(offsets):
        part, off = T.slice_text(data, offsets, i, j)
        doc, value = T.Words(part, off).shingles(k)
        _, value, cuts = T.distinct_per_doc(doc, value, j - i)
        yield i, j, value, cuts


def _sketch(k: int):
    def run(batches):
        for batch in batches:
            for i, j, value, cuts in _sets_of(batch, k):
                running = np.zeros((2, len(value) + 1), np.uint64)
                np.cumsum(T.mix(value + _U(1)), out=running[0, 1:])
                np.cumsum(T.mix(value ^ _U(0x5851F42D4C957F2D)), out=running[1, 1:])
                sums = (running[:, cuts[1:]] - running[:, cuts[:-1]]).astype(np.int64)
                sig = signatures(value, cuts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(cuts), pa.int64()),
                     pa.array(sums[0]), pa.array(sums[1]), _blobs(sig, np.arange(j - i + 1) * SYMBOLS)],
                    names=["doc_id", "n_shingles", "s1", "s2", "sig"])
    return run


def sketches(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: set size, 128-bit hash of the set, signature."""
    python_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _sketch(k), "doc_id long, n_shingles long, s1 long, s2 long, sig binary")


def _keys(batches):
    pick = [(c, i) for c in range(CHUNKS) for i in range(BORDERS[c], BORDERS[c + 1])]
    salt = T.mix(np.arange(1, SYMBOLS * 256 + 1, dtype=np.uint64)).reshape(SYMBOLS, 256)
    for batch in batches:
        n = batch.num_rows
        _, offsets, data = batch.column(1).buffers()
        start = np.frombuffer(offsets, np.int32)[batch.column(1).offset]
        sig = np.frombuffer(data, np.uint8)[start:start + n * SYMBOLS].reshape(n, SYMBOLS)
        value = np.stack([salt[s][sig[:, s]] for s in range(SYMBOLS)], 1)
        total = np.stack([value[:, BORDERS[c]:BORDERS[c + 1]].sum(1) for c in range(CHUNKS)], 1)
        keys = np.stack([total[:, c] - value[:, i] + _U(i) for c, i in pick], 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(T.mix(keys).ravel().astype(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), SYMBOLS)),
             pa.array(np.tile(np.array([i for _, i in pick], np.int32), n))], names=["key", "id", "no"])


def _matrix(column: pa.Array, symbols: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, symbols)


def _near(batches):
    for batch in batches:
        left, right = batch.column(2), batch.column(3)
        keep = (_matrix(left, LONG) != _matrix(right, LONG)).sum(1) <= REACH
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))],
                                         names=["a", "b"])


def _full_sets(k: int):
    def run(batches):
        for batch in batches:
            for i, j, value, cuts in _sets_of(batch, k):
                sig = signatures(value, cuts, LONG)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), _blobs(value, cuts * 8), _blobs(sig, np.arange(j - i + 1) * LONG)],
                    names=["id", "shingles", "long"])
    return run


def _share_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each row of ``a`` and ``b`` agrees in some chunk but for one symbol at most."""
    wrong = a != b
    return np.stack([wrong[:, BORDERS[c]:BORDERS[c + 1]].sum(1) <= 1 for c in range(CHUNKS)], 1).any(1)


def _similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two sets of distinct values pass den * intersection >= num * union."""
    if min(len(x), len(y)) * den < num * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common * den >= num * (len(both) - common)


class _Roots:
    """Components of a cell's rows, numbered by what the rows came with."""

    def __init__(self, c):
        self.up = {x: x for x in c}

    def of(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def _cell_links(rows: dict, num: int, den: int):
    """Links between stragglers and members of one cell that join components."""
    roots, c = _Roots(rows["c"].tolist()), rows["c"].tolist()
    ids, short, long, sets = rows["id"], rows["sig"], rows["long"], rows["shingles"]
    members = np.flatnonzero(~rows["straggler"])
    links = []
    for s in np.flatnonzero(rows["straggler"]).tolist():
        apart = members[(ids[members] != ids[s]) & np.array([roots.of(c[m]) != roots.of(c[s]) for m in members.tolist()], bool)]
        for at in range(0, len(apart), 4096):
            some = apart[at:at + 4096]
            some = some[_share_key(short[some], short[s:s + 1])]
            distance = (long[some] != long[s:s + 1]).sum(1)
            some = some[np.argsort(distance, kind="stable")[:int((distance <= REACH).sum())]]
            mine = np.frombuffer(sets[s], np.uint64)
            for m in some.tolist():
                x, y = roots.of(c[s]), roots.of(c[m])
                if x != y and _similar(mine, np.frombuffer(sets[m], np.uint64), num, den):
                    roots.up[max(x, y)] = min(x, y)
                    links.append((int(ids[s]), int(ids[m])))
    if links:
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def _cells(num: int, den: int):
    """Rows sorted by (zone, mb, sb): a cell's members and stragglers together."""
    def of(held):
        whole = pa.Table.from_batches(held)
        col = lambda n: whole.column(n).combine_chunks()
        yield from _cell_links({"id": col("id").to_numpy(), "c": col("c").to_numpy(), "straggler": col("straggler").to_numpy(zero_copy_only=False),
                                "sig": _matrix(col("sig"), SYMBOLS), "long": _matrix(col("long"), LONG), "shingles": col("shingles").to_pylist()}, num, den)

    def run(batches):
        held, at = [], None
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            cuts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1))).tolist() + [len(key)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                now = tuple(key[lo])
                if now != at and held:
                    yield from of(held)
                    held = []
                at = now
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from of(held)
    return run


def _zone_cells(mixed: DataFrame, classes: DataFrame) -> DataFrame:
    """(zone, mb, sb, id, c, straggler) from the (key, id, c) rows of keys with several components."""
    order = Window.partitionBy("key").orderBy("id")
    chain = mixed.select(F.col("id").alias("a"), F.lead("id").over(order).alias("b")).where(F.col("b").isNotNull()).distinct()
    zones = components(staged(chain, "chain")).select("id", F.col("component").alias("zone"))
    members = staged(mixed.select("id", "c").distinct().join(zones, "id").join(classes.select("id", "n_shingles"), "id")
                     .select("zone", "id", "c", (F.col("n_shingles") * 8 + SYMBOLS + LONG).alias("bytes")), "zone-members")
    sizes = members.groupBy("zone", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    most = F.max_by(F.struct("c", "n", "bytes"), F.struct("n", "c"))
    parts = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")
    zone = sizes.groupBy("zone").agg(most.alias("giant"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).select(
        "zone", F.col("giant.c").alias("giant"), parts(F.col("n"), F.col("bytes")).alias("of_m"),
        parts(F.col("n") - F.col("giant.n"), F.col("bytes") - F.col("giant.bytes")).alias("of_s"))
    dealt = members.join(zone, "zone").withColumn("straggler", F.col("c") != F.col("giant"))
    every = dealt.select("zone", F.pmod(F.xxhash64("id"), "of_m").cast("int").alias("mb"), F.explode(F.sequence(F.lit(0), F.col("of_s") - 1)).alias("sb"),
                         "id", "c", F.lit(False).alias("straggler"))
    asking = dealt.where("straggler").select("zone", F.explode(F.sequence(F.lit(0), F.col("of_m") - 1)).alias("mb"),
                                             F.pmod(F.xxhash64("id"), "of_s").cast("int").alias("sb"), "id", "c", F.lit(True).alias("straggler"))
    return every.unionByName(asking)


def _confirm(num: int, den: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                keep.append(_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), num, den))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])
    return run


def _links(sets: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) within reach whose full sets pass the threshold."""
    sig = sets.select(F.col("id").alias("a"), F.col("long").alias("sa"))
    other = sets.select(F.col("id").alias("b"), F.col("long").alias("sb"))
    near = staged(pairs.join(sig, "a").join(other, "b").select("a", "b", "sa", "sb")
                  .mapInArrow(_near, "a long, b long"), "near-pairs")
    links = staged(
        near.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb")), "b")
        .select("a", "b", "xa", "xb").mapInArrow(_confirm(num, den), "a long, b long"), "links")
    release(near)
    return links


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    n = partitions(spark)
    sketch = staged(sketches(docs, k, id_col, text_col), "sketches")
    classes = staged(
        sketch.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2", "n_shingles")
        .agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")).select("id", "sig", "n_shingles"), "classes")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    by_key = Window.partitionBy("key")
    members = staged(
        classes.select("id", "sig").mapInArrow(_keys, "key long, id long, no int").repartition(n, "key")
        .select("key", "id", "no", F.min("id").over(by_key).alias("least"), F.count("id").over(by_key).alias("n"))
        .where("n > 1"), "members")
    # one shuffle of the texts, at every size: the full sets of all documents that meet another one
    ids = members.select("id").distinct()
    sets = staged(texts.join(ids.hint("shuffle_merge"), "id", "left_semi").select("id", "text")
                  .mapInArrow(_full_sets(k), "id long, shingles binary, long binary"), "sets")

    twos = members.where("n = 2 and id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    links = _links(sets, twos, num, den)
    found = staged(components(links), "found")
    # keys of three and more members may still hold several components
    mixed = members.where("n > 2").select("key", "no", "id")
    for turn in range(ROUNDS + 1):
        lows = Window.partitionBy("key")
        placed = (mixed.select("key", "no", "id").join(found, "id", "left").select("key", "no", "id", F.coalesce("component", "id").alias("c"))
                  .select("key", "no", "id", "c", F.count("id").over(lows).alias("n"), F.min("c").over(lows).alias("lo"), F.max("c").over(lows).alias("hi"))
                  .where("lo < hi"))
        last = turn == ROUNDS
        if not last:
            order = Window.partitionBy("key").orderBy(F.xxhash64("key", "id", F.lit(turn)))
            placed = placed.withColumn("next", F.lead("id").over(order)).withColumn("nc", F.lead("c").over(order))
        kept = staged(placed, "mixed")
        if last:  # what is left: stragglers against all members of their zones
            more = staged(
                _zone_cells(kept, classes).join(classes.select("id", "sig"), "id").join(sets, "id")
                .select("zone", "mb", "sb", "id", "c", "straggler", "sig", "long", "shingles")
                .repartition(n, "zone", "mb", "sb").sortWithinPartitions("zone", "mb", "sb").mapInArrow(_cells(num, den), "a long, b long"), "last-links")
        else:
            draw = F.struct(F.xxhash64("key", "id", F.lit(turn)).alias("h"), "next")
            drawn = kept.where("c <> nc").groupBy("id").agg(F.min(draw).alias("x"), F.max(draw).alias("y"))
            more = _links(sets, drawn.select("id", F.explode(F.array("x.next", "y.next")).alias("next"))
                          .select(F.least("next", "id").alias("a"), F.greatest("next", "id").alias("b")).distinct(), num, den)
        if not more.isEmpty():
            found = joined_components(found, more)
        mixed = kept

    # a set held by many documents is dealt over SALTS rows; one document's own salt is enough for the rest
    sizes = (sketch.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2", "n_shingles")
             .agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")))
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS))
    placed = (sizes.join(found, "id", "left")
              .select("s1", "s2", "n_shingles", F.coalesce("component", "id").alias("component_id"),
                      F.explode(F.when(F.col("n") == 1, F.array(salt("id"))).otherwise(
                          F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).alias("salt")))
    return (sketch.select("doc_id", "n_shingles", "s1", "s2", salt("doc_id").alias("salt"))
            .join(placed, ["s1", "s2", "n_shingles", "salt"], "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def drop_near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that are their component's smallest id (null ids stay)."""
    found = near_duplicates(docs, k, num, den)
    dropped = found.where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti")
