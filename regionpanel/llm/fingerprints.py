"""Document fingerprints: one-permutation MinHash.

Every shingle (``k`` consecutive words, lower-cased A-Z, words split at white
space) is hashed once; the top bits name one of ``BINS`` bins and each bin
keeps its smallest hash.  Empty bins are filled by optimal densification: an
empty bin asks bins in the order of its own universal hash sequence until one
that was filled by a shingle answers, so two documents fill an empty bin from
the same place as often as their sets agree.  ``BITS`` low-order bits of each
bin are stored, packed, as hex text.  Likeness is the share of equal bins,
corrected for the 2**-BITS chance that different values agree, cut to 0..1.

Null text is empty.  A text without words has the fingerprint "" (likeness 1
to another empty one, else 0); fewer than ``k`` words are one shingle.  Equal
texts have equal fingerprints.  Rows with equal ids are ordered by their text;
null ids come last.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as T
from .common import partitions, python_batches

BINS = 256
BITS = 8
SHINGLE = 5

_U = np.uint64
_NONE = _U(0xFFFFFFFFFFFFFFFF)


def fingerprint_matrix(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(documents, BINS) low-order bytes and whether a document has any shingle."""
    n = len(offsets) - 1
    out = np.zeros((n, BINS), np.uint8)
    filled = np.zeros(n, bool)
    for i, j in T.slices(offsets):
        doc, value = T.Words(*T.slice_text(data, offsets, i, j)).shingles(k)
        bins = np.full((j - i) * BINS, _NONE)
        where = doc * BINS + (value >> _U(56)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        if len(order):
            where, value = where[order], value[order]
            first = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
            bins[where[first]] = np.minimum.reduceat(value & _U(0x00FFFFFFFFFFFFFF), first)
        bins = bins.reshape(-1, BINS)
        filled[i:j] = np.bincount(doc, minlength=j - i) > 0
        out[i:j] = (densify(bins, filled[i:j]) & _U(0xFF)).astype(np.uint8)
    return out, filled


def densify(bins: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Empty bins take the value of the first filled bin in their own hash sequence."""
    taken = bins != _NONE
    out = bins.copy()
    row, col = np.nonzero(~taken & filled[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        ask = (T.mix(col.astype(np.uint64) * _U(0x100000001B3) + _U(attempt)) % _U(BINS)).astype(np.int64)
        hit = taken[row, ask]
        out[row[hit], col[hit]] = bins[row[hit], ask[hit]]
        row, col = row[~hit], col[~hit]
    return T.mix(out)


def likeness(a: np.ndarray, b: np.ndarray, has_a, has_b) -> np.ndarray:
    """Bias-corrected similarity of rows of two fingerprint matrices."""
    chance = 2.0 ** -BITS
    same = ((a == b).mean(1) - chance) / (1 - chance)
    both = has_a & has_b
    return np.where(both, np.clip(same, 0.0, 1.0), np.where(has_a | has_b, 0.0, 1.0))


def _hex(matrix: np.ndarray, filled: np.ndarray) -> list[str]:
    return [row.tobytes().hex() if f else "" for row, f in zip(matrix, filled)]


def _join_texts(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return np.frombuffer(b"".join(parts), np.uint8), offsets


def _pairs(k: int):
    """Rows come in order of the chain; each is fingerprinted with its edited text.
    ``halo`` rows only lend their text to the row before them."""

    def digest(ids, texts, following):
        edited = []
        for text, after in zip(texts, following):
            half = len(text) // 2
            edited.append(text[:len(text) - half] + after[:half])
        plain = [t.encode() for t in texts]
        changed = [t.encode() for t in edited]
        own, has = fingerprint_matrix(*_join_texts(plain), k)
        new, has_new = fingerprint_matrix(*_join_texts(changed), k)
        # the next text mostly is the next row: its fingerprint is there already
        n = len(texts)
        source = np.array([i + 1 if i + 1 < n and following[i] is texts[i + 1] else -1 for i in range(n)])
        nxt, has_next = own[source], has[source]
        extra = np.flatnonzero(source < 0)
        nxt[extra], has_next[extra] = fingerprint_matrix(*_join_texts([following[i].encode() for i in extra]), k)
        return pa.RecordBatch.from_pydict({
            "doc_id": ids, "n_chars": [len(t) for t in texts],
            "edited_sha256": [hashlib.sha256(t).hexdigest() for t in changed],
            "fingerprint": _hex(own, has), "edited_fingerprint": _hex(new, has_new),
            "near_edited": likeness(own, new, has, has_new), "near_next": likeness(own, nxt, has, has_next)},
            schema=_OUT)

    def run(batches):
        waiting = None
        for batch in batches:
            rows = batch.to_pydict()
            ids, texts, following = [], [], []
            for part, doc_id, text, halo in zip(rows["part"], rows["id"], rows["text"], rows["halo"]):
                text = text or ""
                if waiting is not None and waiting[0] == part:
                    ids.append(waiting[1])
                    texts.append(waiting[2])
                    following.append(text)
                waiting = None if halo else (part, doc_id, text)
            if ids:
                yield digest(ids, texts, following)
    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                  ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                  ("near_edited", pa.float64()), ("near_next", pa.float64())])


def chained_fingerprints(docs: DataFrame, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (second half replaced by the
    start of the next document in descending id; after the last comes the first).

    The id axis is cut into parts at approximate quantiles (a few numbers per
    part on the driver); each part also gets the first row of the part after
    it, so texts are shuffled once and neighbours are found by sorting parts.
    """
    spark = docs.sparkSession
    python_batches(spark)
    n = partitions(spark)
    cells = 4 * n
    # descending ids, nulls last, ties by text
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = rows.select("id").agg(F.percentile_approx("id", [i / cells for i in range(1, cells)], 20 * cells).alias("q")).first()["q"]
    bounds = sorted(set(cuts or []), reverse=True)
    # part 0 holds the largest ids; nulls are past every bound
    part = F.lit(0)
    if bounds:
        ascending = F.array(*[F.lit(b) for b in reversed(bounds)])
        part = F.when(F.col("id").isNull(), F.lit(len(bounds) + 1)).otherwise(F.size(F.filter(ascending, lambda b: b > F.col("id"))))
    rows = rows.withColumn("part", part)
    heads = {r["part"]: r["id"] for r in rows.groupBy("part").agg(F.max("id").alias("id")).collect()}
    if not heads:
        return rows.select("part", "id", "text", F.lit(False).alias("halo")).mapInArrow(_pairs(k), _DDL)
    # the first row of each part, told to the part before it
    used = sorted(heads)
    before = F.create_map(*[F.lit(x) for i, p in enumerate(used) for x in (p, used[i - 1])])
    lead = F.col("id").isin([i for i in heads.values() if i is not None]) | F.col("id").isNull()
    halos = (rows.where(lead).groupBy("part", "id").agg(F.min("text").alias("text"))
             .select(F.element_at(before, F.col("part")).alias("part"), "id", "text", F.lit(True).alias("halo")))
    dealt = rows.select("part", "id", "text", F.lit(False).alias("halo")).unionByName(halos).repartition(n, "part")
    return (dealt.sortWithinPartitions("part", "halo", F.col("id").desc_nulls_last(), "text")
            .select("part", "id", "text", "halo").mapInArrow(_pairs(k), _DDL))


_DDL = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")
