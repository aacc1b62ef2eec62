"""Repeated-substring removal by prefix-free parsing.

A byte is removed when a string of ``length`` bytes that covers it also starts
in a document with a smaller id.

1. **Parse.**  A rolling hash over short grams of bytes triggers phrase borders: the
   trigger of a window (the ``length`` bytes from one start) is its leftmost
   smallest gram hash, and a phrase is a maximal run of starts with the same
   trigger, read to the end of its last window.  Every window lies in exactly
   one phrase, and equal windows have equal triggers at equal offsets, so
   phrases of repeated text are equal wherever it stands (prefix-free: phrases
   overlap by a window, none can be split differently in another context).
   Equal phrases that follow each other (a long run of one byte, a short period)
   are one record with a count.
2. **Dictionary.**  Phrases are shuffled by trigger and sorted; equal phrases
   collapse to one dictionary entry with its first document.  All later
   occurrences (the parse) are repeats as a whole.
3. **Suffixes of the dictionary.**  The windows of a phrase fall into thirds by
   where they hold the trigger; the windows of a third share a core.  Only
   entries whose trigger and core another entry has too can share a window with
   it.  The bytes of such a third travel to the task of their (trigger, core);
   there the suffixes that start in them are put into byte order to the depth of
   ``length`` (a suffix array cut at that depth), which brings equal ones
   together: all but those of the smallest document are repeats.  A third
   travels and comes back as one record, whatever the number of tasks.
4. **Corpus order.**  Every suffix of the corpus lies in one occurrence of one
   phrase, so the marks of a dictionary entry hold where the entry occurs first
   and the parse (step 2) gives its other occurrences.

Suffixes are compared byte by byte; phrases by 64-bit hashes.  A (trigger,
core) that over ``HOT`` thirds share is dealt out once more by the windows
themselves.  A map task that has already met a phrase or a third in a smaller
document marks it there and does not send it, so a passage held by a third of
the corpus costs about one record a task.  Blocks are sorted by Spark and taken
one destination at a time; nothing is collected, sampled or capped.

Null text is empty; texts shorter than ``length`` keep all bytes; rows with a
null id count as after all others; rows sharing an id never repeat each other;
an empty table gives an empty result; other columns are untouched.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as T
from .common import partitions, python_batches, staged

_U = np.uint64
LAST = (1 << 63) - 1
BLOCK = "dest int, kind int, ids binary, body binary"
THIRDS = ("x", "y", "z")
#: thirds of one (trigger, core) that one task compares at most; bytes it compares at once
HOT, CHUNK = 50_000, 4 << 20
#: thirds that a map task remembers, and the bytes of phrase records meant for one destination
SEEN, DEST_BYTES = 1 << 16, 32 << 20
#: one phrase record: trigger, phrase hash, hashes of the cores of its window thirds (0: no window there),
#: document, first start, number of further starts, offset of the trigger from the first start,
#: how often the phrase follows itself
PHRASE = np.dtype([("g", "<u4"), ("p", "<u8"), ("x", "<u2"), ("y", "<u2"), ("z", "<u2"), ("d", "<i4"), ("a", "<i4"),
                   ("n", "<u2"), ("o", "<u2"), ("r", "<u4")])
#: a third to be compared: its (trigger, core), first start, further starts, and how often it recurs at which step
THIRD = np.dtype([("key", "<u8"), ("a", "<i4"), ("n", "<u2"), ("step", "<u2"), ("r", "<u4")])
#: a document in a block: its id and a hash of its text
DOC = np.dtype([("k", "<i8"), ("th", "<i4")])
RUN = np.dtype([("a", "<i4"), ("b", "<i4")])


def gram_size(length: int) -> int:
    return max(4, length * 8 // 50)


def third(t: int, length: int) -> tuple[int, int]:
    """Smallest and largest offset of the trigger in the windows of one third."""
    width = length - gram_size(length) + 1
    return width * t // 3, width * (t + 1) // 3 - 1


def parse(data: np.ndarray, offsets: np.ndarray, length: int):
    """Phrase records of the documents in one slice (``d`` is the index in the slice) and their triggers."""
    k = gram_size(length)
    n = len(data)
    if n < length:
        return np.zeros(0, PHRASE), np.zeros(0, np.uint64)
    prefix = T.prefix_hash(T.BYTE_CODES[data])
    at = np.arange(n - k + 1)
    gram = T.range_hash(prefix, at, at + k)
    # smallest hash of each window by doubling; its position rides in the low half, so ties go left
    best = (gram & _U(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    span, width = 1, length - k + 1
    while span < width:
        step = min(span, width - span)
        best = np.minimum(best[:-step], best[step:])
        span += step
    owner = (best & _U(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(owner)]
    start = np.flatnonzero(np.arange(len(owner)) + length <= offsets[doc + 1])
    if not len(start):
        return np.zeros(0, PHRASE), np.zeros(0, np.uint64)
    new = np.ones(len(start), bool)
    new[1:] = (owner[start[1:]] != owner[start[:-1]]) | (doc[start[1:]] != doc[start[:-1]])
    first = np.flatnonzero(new)
    a = start[first]
    e = start[np.append(first[1:], len(start)) - 1]
    i = owner[a]
    out = np.empty(len(a), PHRASE)
    out["g"] = gram[i].astype(np.uint32)
    out["p"] = T.mix(T.range_hash(prefix, a, e + length) + (i - a).astype(np.uint64))
    for t, name in enumerate(THIRDS):  # a core is the part that all windows of a third share
        lo, hi = third(t, length)
        has = (a <= i - lo) & (e >= i - hi)
        core = 1 + T.range_hash(prefix, np.where(has, i - lo, 0), np.where(has, i - hi + length, 0)) % _U(65535)
        out[name] = np.where(has, core, 0)
    out["d"] = doc[a]
    out["a"] = a - offsets[doc[a]]
    out["n"] = e - a
    out["o"] = i - a
    again = np.zeros(len(out), bool)
    again[1:] = (out["p"][1:] == out["p"][:-1]) & (out["g"][1:] == out["g"][:-1]) & (out["d"][1:] == out["d"][:-1]) \
        & (out["n"][1:] == out["n"][:-1]) & (a[1:] == e[:-1] + 1)
    lead = np.flatnonzero(~again)
    out["r"][lead] = np.diff(np.append(lead, len(out))) - 1
    return out[lead], gram[i][lead]


def last_start(rec: np.ndarray) -> np.ndarray:
    """Last start of each record, its repeats included."""
    return rec["a"] + (rec["n"].astype(np.int64) + 1) * (rec["r"].astype(np.int64) + 1) - 1


def merge_runs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Runs of starts [a, b], joined where they touch."""
    if not len(a):
        return np.zeros(0, RUN)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1] + 1
    first = np.flatnonzero(new)
    out = np.empty(len(first), RUN)
    out["a"], out["b"] = a[first], b[np.append(first[1:], len(a)) - 1]
    return out


FLAGS = "k long, th int, kind int, runs binary"
_FLAGS = pa.schema([("k", pa.int64()), ("th", pa.int32()), ("kind", pa.int32()), ("runs", pa.binary())])
_BLOCK = pa.schema([("dest", pa.int32()), ("kind", pa.int32()), ("ids", pa.binary()), ("body", pa.binary())])
WHOLE, SUFFIXES = 1, 2  # all windows of the run are repeats / its windows must be compared


def _flags(ids: np.ndarray, d: np.ndarray, a: np.ndarray, b: np.ndarray, kind: int) -> pa.RecordBatch:
    """One row for each document with its runs of starts [a, b], touching ones joined."""
    order = np.lexsort((a, d))
    d, a, b = d[order], a[order], b[order]
    fresh = np.ones(len(d), bool)
    fresh[1:] = d[1:] != d[:-1]
    new = fresh.copy()
    new[1:] |= a[1:] > b[:-1] + 1
    first = np.flatnonzero(new)
    runs = np.empty(len(first), RUN)
    runs["a"], runs["b"] = a[first], b[np.append(first[1:], len(a))[:len(first)] - 1] if len(first) else 0
    docs = d[fresh]
    cuts = np.append(np.searchsorted(d[first], docs), len(first)).astype(np.int32) * RUN.itemsize
    blobs = pa.Array.from_buffers(pa.binary(), len(docs), [None, pa.py_buffer(cuts.astype(np.int32).tobytes()),
                                                           pa.py_buffer(runs.tobytes())])
    return pa.RecordBatch.from_arrays(
        [pa.array(ids["k"][docs]), pa.array(ids["th"][docs]),
         pa.array(np.full(len(docs), kind, np.int32)), blobs], schema=_FLAGS)


def _docs(batch: pa.RecordBatch) -> np.ndarray:
    ids = np.empty(batch.num_rows, DOC)
    ids["k"], ids["th"] = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
    return ids


def _blocks(records: np.ndarray, key: np.ndarray, ids: np.ndarray, dests: int):
    """One row for each destination, with the documents it names."""
    dest = (T.mix(key) % _U(dests)).astype(np.int32)
    order = np.argsort(dest, kind="stable")
    records, dest = records[order], dest[order]
    cuts = np.flatnonzero(np.append(True, dest[1:] != dest[:-1]))
    rows = {"dest": [], "kind": [], "ids": [], "body": []}
    for lo, hi in zip(cuts, np.append(cuts[1:], len(dest))):
        part = records[lo:hi].copy()
        used, part["d"] = np.unique(part["d"], return_inverse=True)
        rows["dest"].append(int(dest[lo]))
        rows["kind"].append(0)
        rows["ids"].append(ids[used].tobytes())
        # field by field: sorted document numbers and positions compress, hashes do not
        rows["body"].append(b"".join(np.ascontiguousarray(part[f]).tobytes() for f in part.dtype.names))
    return rows


def _passing(flags: pa.RecordBatch, dests: int) -> pa.RecordBatch:
    """Marks made in the map task travel through the same shuffle."""
    ids = np.empty(flags.num_rows, DOC)
    ids["k"], ids["th"] = flags.column(0).to_numpy(), flags.column(1).to_numpy()
    cuts = (np.arange(len(ids) + 1) * DOC.itemsize).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(((ids["k"] ^ ids["th"]) % dests).astype(np.int32)), flags.column(2),
         pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(ids.tobytes())]),
         flags.column(3)], schema=_BLOCK)


def _unpack(body: bytes, dtype: np.dtype) -> np.ndarray:
    n = len(body) // dtype.itemsize
    out, at = np.empty(n, dtype), 0
    for f in dtype.names:
        size = dtype[f].itemsize * n
        out[f] = np.frombuffer(body, dtype[f], n, at)
        at += size
    return out


def _first_docs(keys: tuple, k: np.ndarray):
    """(order, group number, is the group's smallest id) with rows sorted by keys then id."""
    order = np.lexsort((k,) + keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = reduce(np.logical_or, [x[order][1:] != x[order][:-1] for x in keys])
    group = np.cumsum(new) - 1
    first = k[order][np.flatnonzero(new)]
    return order, group, k[order] == first[group] if len(order) else new


def _phrase_blocks(length: int, dests: int):
    def run(batches):
        for batch in batches:
            data, offsets = T.text_column(batch)
            ids = _docs(batch)
            for i, j in T.slices(offsets, 4 * T.SLICE_BYTES):
                rec, trigger = parse(*T.slice_text(data, offsets, i, j), length)
                if not len(rec):
                    continue
                own = ids[i:j]
                order, _, smallest = _first_docs((rec["g"], rec["p"]), own["k"][rec["d"]])
                keep = np.zeros(len(rec), bool)
                keep[order[smallest]] = True
                if not keep.all():
                    seen = rec[~keep]
                    yield _passing(_flags(own, seen["d"], seen["a"], last_start(seen), WHOLE), dests)
                yield pa.RecordBatch.from_pydict(_blocks(rec[keep], trigger[keep], own, dests), _BLOCK)
    return run


def _destinations(batches):
    """The blocks of one destination at a time, from rows sorted by it: (records,
    their documents, marks that pass through)."""
    at, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if row[0] != at and rows:
                yield _joined(rows)
                rows = []
            at = row[0]
            rows.append(row)
    if rows:
        yield _joined(rows)


def _joined(rows):
    records, ids, base = [], [], 0
    passed = {"k": [], "th": [], "kind": [], "runs": []}
    for _, kind, doc_ids, body in rows:
        own = np.frombuffer(doc_ids, DOC)
        if kind:
            for name, value in zip(passed, (int(own["k"][0]), int(own["th"][0]), kind, body)):
                passed[name].append(value)
            continue
        rec = _unpack(body, PHRASE)
        rec["d"] += base
        base += len(own)
        records.append(rec)
        ids.append(own)
    rec = np.concatenate(records) if records else np.zeros(0, PHRASE)
    return rec, np.concatenate(ids) if ids else np.zeros(0, DOC), passed


def _shared(g: np.ndarray, half: np.ndarray, phrase: np.ndarray, entry: np.ndarray):
    """Which dictionary entries share a trigger and a half with another entry."""
    out = np.zeros(len(g), bool)
    rows = np.flatnonzero(entry & (half > 0))
    order = rows[np.lexsort((phrase[rows], half[rows], g[rows]))]
    if not len(order):
        return out
    new = np.ones(len(order), bool)
    new[1:] = (g[order][1:] != g[order][:-1]) | (half[order][1:] != half[order][:-1])
    group = np.cumsum(new) - 1
    other = np.ones(len(order), bool)
    other[1:] = new[1:] | (phrase[order][1:] != phrase[order][:-1])
    out[order] = np.bincount(group, other)[group] > 1
    return out


def _packed(ids: np.ndarray, d: np.ndarray, records: np.ndarray, kind: int) -> pa.RecordBatch:
    """One row for each document with its records."""
    order = np.argsort(d, kind="stable")
    d, records = d[order], records[order]
    cuts = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
    docs = d[cuts]
    at = (np.append(cuts, len(d)) * records.dtype.itemsize).astype(np.int32)
    blobs = pa.Array.from_buffers(pa.binary(), len(docs), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(records.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(ids["k"][docs]), pa.array(ids["th"][docs]),
                                       pa.array(np.full(len(docs), kind, np.int32)), blobs], schema=_FLAGS)


def _dictionary(length: int):
    def run(batches):
        for rec, ids, passed in _destinations(batches):
            if passed["k"]:
                yield pa.RecordBatch.from_pydict(passed, _FLAGS)
            if not len(rec):
                continue
            order, group, smallest = _first_docs((rec["g"], rec["p"]), ids["k"][rec["d"]])
            rec = rec[order]
            if not smallest.all():
                later = rec[~smallest]
                yield _flags(ids, later["d"], later["a"], last_start(later), WHOLE)
            for t, name in enumerate(THIRDS):
                lo, hi = third(t, length)
                mask = _shared(rec["g"], rec[name], group, smallest)
                if mask.any():
                    some = rec[mask]
                    trigger = some["a"] + some["o"].astype(np.int32)
                    out = np.empty(len(some), THIRD)
                    out["key"] = T.mix((some["g"].astype(np.uint64) << _U(32)) | (some[name].astype(np.uint64) << _U(2)) | _U(t))
                    out["a"] = np.maximum(some["a"], trigger - hi)
                    out["n"] = np.minimum(some["a"] + some["n"].astype(np.int32), trigger - lo) - out["a"]
                    out["step"], out["r"] = some["n"] + 1, some["r"]
                    yield _packed(ids, some["d"], out, SUFFIXES)
    return run


RUNS = "key long, k long, th int, a int, n int, step int, r int, body binary"
_RUNS = pa.schema([("key", pa.int64()), ("k", pa.int64()), ("th", pa.int32()), ("a", pa.int32()), ("n", pa.int32()),
                   ("step", pa.int32()), ("r", pa.int32()), ("body", pa.binary())])


class _Sent:
    """Thirds on their way out of a map task; one that a smaller document had there is marked instead (n = -1)."""

    def __init__(self):
        self.seen: dict = {}

    def rows(self, thirds):
        out = {name: [] for name in _RUNS.names}
        for key, k, th, a, n, step, r, body in thirds:
            first = self.seen.get(body)
            if first is not None and first < k:
                starts = a + np.arange(r + 1, dtype=np.int64) * step
                runs = merge_runs(starts, starts + n)
                n, body = -1, runs.tobytes()
            elif first is None or k < first:
                if len(self.seen) >= SEEN:
                    self.seen.clear()
                self.seen[body] = k
            for name, value in zip(out, (key, k, th, a, n, step, r, body)):
                out[name].append(value)
        return pa.RecordBatch.from_pydict(out, _RUNS)


def _thirds(length: int):
    """The bytes of the thirds to be compared."""
    def run(batches):
        sent = _Sent()
        for batch in batches:
            data, offsets = T.text_column(batch)
            checks = batch.column(batch.schema.get_field_index("check")).to_pylist()
            ids = _docs(batch)

            def of_batch():
                for d in np.argsort(ids["k"], kind="stable").tolist():
                    text, k, th = data[offsets[d]:offsets[d + 1]], int(ids["k"][d]), int(ids["th"][d])
                    rec = np.frombuffer(b"".join(checks[d] or ()), THIRD)
                    for key, a, n, step, r in zip(rec["key"].astype(np.int64).tolist(), rec["a"].tolist(), rec["n"].tolist(),
                                                  rec["step"].tolist(), rec["r"].tolist()):
                        yield key, k, th, a, n, step, r, text[a:a + n + length].tobytes()

            yield sent.rows(of_batch())
    return run


def _single_windows(length: int):
    """Thirds as single windows, each keyed by itself."""
    def run(batches):
        sent = _Sent()
        for batch in batches:
            def of_batch():
                for key, k, th, a, n, step, r, body in zip(*(batch.column(i).to_pylist() for i in range(8))):
                    for at in range(n + 1):
                        window = body[at:at + length]
                        own = int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True)
                        yield own, k, th, a + at, 0, step, r, window
            yield sent.rows(of_batch())
    return run


def suffix_order(bodies: np.ndarray, starts: np.ndarray, length: int, k: np.ndarray):
    """(order, marks): the suffixes from ``starts`` in byte order to the depth of ``length``,
    equal ones by document, and which of them have an equal one in a smaller document."""
    width = -(-length // 8) * 8
    depth = np.zeros((len(starts), width), np.uint8)
    depth[:, :length] = np.lib.stride_tricks.sliding_window_view(bodies, length)[starts]
    words = depth.view(">u8").astype(np.uint64)
    order = np.lexsort((k, *words.T[::-1]))
    words = words[order]
    new = np.ones(len(order), bool)
    new[1:] = (words[1:] != words[:-1]).any(1)
    first = np.flatnonzero(new)
    least = k[order][first]
    return order, k[order] > least[np.cumsum(new) - 1]


def _compared(length: int):
    """Rows sorted by key: the starts whose suffix a smaller document has too."""
    def compare(rows):
        k, th, a, n, step, r = (np.array([x[i] for x in rows], np.int64) for i in range(1, 7))
        sizes = np.array([len(x[7]) for x in rows], np.int64)
        row = np.repeat(np.arange(len(rows)), n + 1)
        within = np.arange(len(row)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)
        starts = np.repeat(np.cumsum(sizes) - sizes, n + 1) + within
        order, marked = suffix_order(np.frombuffer(b"".join(x[7] for x in rows), np.uint8), starts, length, k[row])
        found = np.sort(order[marked])
        if len(found):
            again = r[row[found]] + 1
            which = np.repeat(found, again)
            turn = np.arange(len(which)) - np.repeat(np.cumsum(again) - again, again)
            at = a[row[which]] + within[which] + turn * step[row[which]]
            ids = np.empty(len(rows), DOC)
            ids["k"], ids["th"] = k, th
            ids, doc = np.unique(ids, return_inverse=True)
            yield _flags(ids, doc[row[which]], at, at, WHOLE)

    def run(batches):
        rows, size, at = [], 0, None
        passed = {name: [] for name in _FLAGS.names}
        for batch in batches:
            for x in zip(*(batch.column(i).to_pylist() for i in range(8))):
                if x[4] < 0:
                    for name, value in zip(passed, (x[1], x[2], WHOLE, x[7])):
                        passed[name].append(value)
                    continue
                if size >= CHUNK and x[0] != at:
                    yield from compare(rows)
                    rows, size = [], 0
                at = x[0]
                rows.append(x)
                size += (x[4] + 1) * length
            if passed["k"]:
                yield pa.RecordBatch.from_pydict(passed, _FLAGS)
                passed = {name: [] for name in _FLAGS.names}
        if rows:
            yield from compare(rows)
    return run


def _run_columns(blobs):
    runs = np.frombuffer(b"".join(blobs), RUN)
    return runs["a"], runs["b"]


def _per_doc(flags: DataFrame, kind: int, name: str) -> DataFrame:
    return flags.where(F.col("kind") == kind).groupBy("k", "th").agg(F.collect_list("runs").alias(name))


def repeated_runs(docs: DataFrame, length: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``_runs``: array of blocks of (first, last) starts of the
    ``length``-byte strings that also start in a document with a smaller id."""
    spark = docs.sparkSession
    python_batches(spark)
    n = partitions(spark)
    # the scan's size, times what compression saves and records add: it shapes the blocks only
    expected = 4 * int(str(docs.select(text_col)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    dests = n * min(1 << 10, max(2, -(-expected // (n * DEST_BYTES))))
    keyed = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("k"),
        F.hash(F.col(text_col)).alias("th"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    with_text = keyed.select("k", "th", F.col(f"row.{text_col}").alias("text"))
    flags = staged(
        with_text.mapInArrow(_phrase_blocks(length, dests), BLOCK)
        .repartition(n, "dest").sortWithinPartitions("dest")
        .mapInArrow(_dictionary(length), FLAGS), "phrase-flags")
    thirds = staged(
        with_text.join(_per_doc(flags, SUFFIXES, "check"), ["k", "th"]).select("k", "th", "text", "check")
        .mapInArrow(_thirds(length), RUNS), "thirds")
    hot = staged(thirds.where("n >= 0").groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > HOT).select("key"), "hot-thirds")
    asked = thirds
    if not hot.isEmpty():
        single = thirds.where("n >= 0").join(hot, "key", "left_semi").select(*_RUNS.names).mapInArrow(_single_windows(length), RUNS)
        asked = thirds.where("n < 0").unionByName(thirds.where("n >= 0").join(hot, "key", "left_anti").select(*_RUNS.names)).unionByName(single)
    windows = staged(asked.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_compared(length), FLAGS), "window-flags")
    runs = _per_doc(flags.unionByName(windows), WHOLE, "_runs")
    return keyed.join(runs, ["k", "th"], "left").select("row.*", F.coalesce("_runs", F.array()).alias("_runs"))


def covered(blobs, length: int, n: int):
    """Removed byte ranges of one text as sorted arrays (begin, end)."""
    runs = merge_runs(*_run_columns(blobs or ()))
    spans = merge_runs(runs["a"], runs["b"] + (length - 1))
    return spans["a"].astype(np.int64), np.minimum(spans["b"].astype(np.int64) + 1, n)


def _digest(length: int):
    def run(batches):
        for batch in batches:
            data, offsets = T.text_column(batch)
            runs = batch.column(batch.schema.get_field_index("_runs")).to_pylist()
            n_removed, n_spans, sha = [], [], []
            for d in range(batch.num_rows):
                text = data[offsets[d]:offsets[d + 1]]
                a, b = covered(runs[d], length, len(text))
                keep = np.ones(len(text), bool)
                for x, y in zip(a, b):
                    keep[x:y] = False
                n_removed.append(int((b - a).sum()))
                n_spans.append(len(a))
                sha.append(hashlib.sha256(text[keep].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return run


def removal_digest(docs: DataFrame, length: int = 50) -> DataFrame:
    """One row per document: bytes, removed bytes, maximal removed runs, hash of what is left."""
    runs = repeated_runs(docs.select("doc_id", "text"), length)
    return runs.select("doc_id", "text", "_runs").mapInArrow(
        _digest(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _cut_text(length: int):
    def run(batches):
        for batch in batches:
            data, offsets = T.text_column(batch)
            runs = batch.column(batch.schema.get_field_index("_runs")).to_pylist()
            out = []
            for d in range(batch.num_rows):
                text = data[offsets[d]:offsets[d + 1]]
                a, b = covered(runs[d], length, len(text))
                keep = np.ones(len(text), bool)
                lead = (text & 0xC0) != 0x80
                for x, y in zip(a, b):  # only whole characters go
                    while x < y and not lead[x]:
                        x += 1
                    while y > x and y < len(text) and not lead[y]:
                        y -= 1
                    keep[x:y] = False
                out.append(text[keep].tobytes().decode("utf-8"))
            at = batch.schema.get_field_index("text")
            cols = [pa.array(out, pa.string()) if i == at else batch.column(i)
                    for i in range(batch.num_columns) if batch.schema.names[i] != "_runs"]
            names = [c for c in batch.schema.names if c != "_runs"]
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def remove_repeats(docs: DataFrame, length: int, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with repeated passages cut from ``text`` (whole characters only) and
    ``n_chars``, where there is one, counted anew.  Rows without repeats keep their text."""
    schema = docs.schema
    out = repeated_runs(docs, length, id_col).mapInArrow(_cut_text(length), schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(schema["n_chars"].dataType))
    return out.select(*docs.columns)
