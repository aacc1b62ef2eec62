"""Benchmark decontamination by template canonicalisation.

Texts and benchmark items become word sequences (ASCII letters and digits and
all non-ASCII characters; A-Z lower-cased) in which numbers, units and names
are typed placeholders.  A name is a capitalised word inside a sentence, or a
listed first name.  Windows of ``WINDOW`` canonical words are hash-joined:
an equal window means an equal template whatever stands in its slots.

A window whose words are equal as they stand (case aside) is evidence too,
whatever its words are: every window also joins by a hash of its raw words.
Windows with fewer than ``MIN_PLAIN`` ordinary words join by that hash only.

Hits of one document, item and diagonal (offset between the two word
positions) are checked for slot consistency: each value of the item must
always have become the same value of the document, and no two the same one.
A changed value that breaks this drops the windows that hold it; the others
stay.  A diagonal on which one value became two others is no copy of the
template and drops whole, unless ``RUN_WORDS`` words in a row are equal.  The
share of an item's words covered by the windows left decides, or a run of
``RUN_WORDS`` equal words whatever its share of a long item.

Items shorter than ``WINDOW`` words are one window of their own length, and
documents are cut into windows of each such length that occurs (seven at
most); so an item of one word is found wherever that word stands.

Benchmark windows are counted; up to ``BROADCAST_WINDOWS`` their hashes go to
every task, which then sends only windows that hit, and the join is a
broadcast; beyond it all windows go through a shuffle join.  The rows are the
same.

Null or empty text or item: no windows, not contaminated.  Rows sharing an id
(nulls too) are one document.  An empty table of items marks nothing.  Extra
columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as T
from .common import python_batches

WINDOW = 8
MIN_PLAIN = 4
MIN_COVER = 0.5
RUN_WORDS = 25
BROADCAST_WINDOWS = 500_000
#: bytes of the item windows, slots included, up to which they are broadcast
BROADCAST_BYTES = 64 << 20

#: fixed values
UNITS = ("mm cm m km mg g kg lb lbs oz ml l litre litres liter liters inch inches foot feet yard yards mile miles second "
         "seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro "
         "euros pound pounds percent degree degrees meter meters metre metres gram grams kilogram kilograms ton tons").split()
NAMES = ("james john robert michael william david richard joseph thomas charles mary patricia jennifer linda elizabeth "
         "barbara susan jessica sarah karen alice bob carol dave emma emily olivia sophia liam noah lucas anna maria peter "
         "paul mark george tom tim sam max ben jack kate lucy julia natalia weng betty janet tina marie hans pierre juan "
         "carlos jose luis").split()

_U = np.uint64
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9]] = True
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?:;\n\r\"(|"]] = True
_MARKS = T.mix(np.array([11, 22, 33], np.uint64))
_RAW = _U(0x5851F42D4C957F2D)


def _hashes(words) -> np.ndarray:
    raw = [w.encode() for w in words]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(w) for w in raw], out=offsets[1:])
    prefix = T.prefix_hash(T.BYTE_CODES[np.frombuffer(b"".join(raw), np.uint8)])
    return np.sort(T.range_hash(prefix, offsets[:-1], offsets[1:]))


_UNIT_HASHES, _NAME_HASHES = _hashes(UNITS), _hashes(NAMES)


def _found(values, table):
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def canonical(words: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """(canonical hash, slot type: 0 none, 1 number, 2 unit, 3 name) of every word."""
    data, start, end = words.data, words.start, words.end
    kind = np.zeros(len(start), np.int8)
    if not len(start):
        return words.hash, kind
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    seen = np.maximum.accumulate(np.where(_BLANK[data], -1, np.arange(len(data))))  # last byte that is no blank
    before = np.where(start > 0, seen[start - 1], -1)
    opens = (before < words.offsets[words.doc]) | _ENDS[data[np.maximum(before, 0)]]
    first = data[start]
    second = data[np.minimum(start + 1, len(data) - 1)]
    capital = (first >= 65) & (first <= 90) & (end - start > 1) & ((second >= 97) & (second <= 122) | (second >= 128))
    kind[capital & ~opens | capital & _found(words.hash, _NAME_HASHES)] = 3
    kind[_found(words.hash, _UNIT_HASHES)] = 2
    kind[digits[end] - digits[start] == end - start] = 1
    return np.where(kind > 0, _MARKS[kind - 1], words.hash), kind


def _runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words, documents not regarded."""
    acc = h[:len(h) - k + 1] + _U(k)
    for i in range(1, k):
        acc = T.mix(acc * _U(3) + h[i:len(h) - k + 1 + i])
    return T.mix(acc)


def _windows(wanted, short=None):
    """Rows (id, pos, window, n_words, size, raw, slots): slots are the raw hashes of a template's slots in order.

    Windows have ``WINDOW`` words, or a length in ``short``; without it, an item below ``WINDOW`` words is one window."""
    def run(batches):
        for batch in batches:
            data, offsets = T.text_column(batch)
            for i, j in T.slices(offsets):
                words = T.Words(*T.slice_text(data, offsets, i, j), T.WORD_ALNUM)
                code, kind = canonical(words)
                plain = np.concatenate([[0], np.cumsum(kind == 0)])
                for k in range(1, WINDOW + 1):
                    if len(words.hash) < k or short is not None and k < WINDOW and k not in short:
                        continue
                    at = np.flatnonzero(words.doc[:len(words.hash) - k + 1] == words.doc[k - 1:])
                    if short is None and k < WINDOW:
                        at = at[words.counts[words.doc[at]] == k]
                    ordinary = plain[at + k] - plain[at]
                    template = (ordinary >= MIN_PLAIN) & (ordinary < k)
                    for raw, starts, value in ((True, at, _runs(words.hash, k)[at] ^ _RAW), (False, at[template], _runs(code, k)[at[template]])):
                        if wanted is not None:
                            hit = _found(value, wanted) if len(wanted) else np.zeros(len(value), bool)
                            starts, value = starts[hit], value[hit]
                        if not len(starts):
                            continue
                        doc, n = words.doc[starts], len(starts)
                        slots = [() if raw else words.hash[a:a + k][kind[a:a + k] > 0].astype(np.int64) for a in starts]
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(starts - words.first[doc], pa.int64()),
                             pa.array(value.astype(np.int64)), pa.array(words.counts[doc], pa.int64()),
                             pa.array(np.full(n, k), pa.int64()), pa.array(np.full(n, raw)), pa.array(slots, pa.list_(pa.int64()))],
                            names=["id", "pos", "window", "n_words", "size", "raw", "slots"])
    return run


_ROW = "id long, pos long, window long, n_words long, size long, raw boolean, slots array<long>"


def leaks(docs: DataFrame, benchmark: DataFrame, min_cover: float = MIN_COVER) -> DataFrame:
    """(doc_id, item_id, hits, coverage, changed): items whose template a document holds."""
    spark = docs.sparkSession
    python_batches(spark)
    items = (benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text")).where("id is not null")
             .mapInArrow(_windows(None), _ROW))
    distinct = items.select("window").distinct().limit(BROADCAST_WINDOWS + 1)
    hashes = [r["window"] for r in distinct.collect()]
    wanted = np.sort(np.array(hashes, np.int64).astype(np.uint64)) if len(hashes) <= BROADCAST_WINDOWS else None
    short = {r["n_words"] for r in items.where(F.col("n_words") < WINDOW).select("n_words").distinct().collect()}
    right = items.select(F.col("id").alias("item_id"), F.col("pos").alias("b_pos"), "window",
                         F.col("n_words").alias("item_words"), F.col("size").alias("b_size"), F.col("raw").alias("b_raw"), F.col("slots").alias("b_slots"))
    weight = items.agg(F.sum(F.size("slots") * 8 + 80).alias("b")).first().b or 0
    if wanted is not None and weight <= BROADCAST_BYTES:
        right = F.broadcast(right)
    hits = (docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text")).mapInArrow(_windows(wanted, short), _ROW)
            .join(right, "window").where((F.size("slots") == F.size("b_slots")) & (F.col("size") == F.col("b_size")) & (F.col("raw") == F.col("b_raw")))
            .select("id", "item_id", "item_words", (F.col("pos") - F.col("b_pos")).alias("diagonal"), F.struct(
                "b_pos", "size", "raw", F.array_distinct(F.arrays_zip(F.col("b_slots").alias("b"), F.col("slots").alias("d"))).alias("pairs")).alias("w")))
    # one diagonal has at most twice as many hits as the item has words: the lists stay that short
    lines = hits.groupBy("id", "item_id", "item_words", "diagonal").agg(F.collect_set("w").alias("ws"))
    lines = lines.withColumn("pairs", F.array_distinct(F.flatten("ws.pairs")))
    lines = lines.withColumn("new", F.filter("pairs", lambda p: p["b"] != p["d"]))
    lines = (lines.withColumn("torn", F.size("new") > F.size(F.array_distinct("new.b")))
             .withColumn("bad", F.filter("new", lambda p: F.exists("pairs", lambda q: (q["b"] == p["b"]) != (q["d"] == p["d"]))))
             .withColumn("same", F.array_sort(F.transform(F.filter("ws", lambda w: w["raw"]), lambda w: w["b_pos"]))))
    # a run of equal windows: so many positions later the position is so many higher
    more = RUN_WORDS - WINDOW
    long = F.coalesce(F.exists(F.zip_with("same", F.slice("same", more + 1, F.greatest(F.size("same"), F.lit(1))),
                                          lambda x, y: y - x == more), lambda x: F.coalesce(x, F.lit(False))), F.lit(False))
    lines = lines.withColumn("long", long).where("long or not torn")
    kept = F.filter("ws", lambda w: F.when(F.col("torn"), w["raw"]).otherwise(~F.arrays_overlap(w["pairs"], F.col("bad"))))
    lines = lines.withColumn("ws", kept).where(F.size("ws") > 0)
    covers = F.array_distinct(F.flatten(F.transform("ws", lambda w: F.sequence(w["b_pos"], w["b_pos"] + w["size"] - 1))))
    found = (lines.select("id", "item_id", "item_words", "long", F.transform("ws", lambda w: w["b_pos"]).alias("at"), covers.alias("words"),
                          F.exists(F.flatten("ws.pairs"), lambda p: p["b"] != p["d"]).alias("changed"))
             .groupBy("id", "item_id", "item_words").agg(
                 F.size(F.array_distinct(F.flatten(F.collect_set("at")))).alias("hits"),
                 F.size(F.array_distinct(F.flatten(F.collect_set("words")))).alias("covered"),
                 F.max("changed").alias("changed"), F.max("long").alias("long")))
    covered = F.least(F.lit(1.0), F.col("covered") / F.greatest("item_words", F.lit(1)))
    return (found.withColumn("coverage", covered).where((F.col("coverage") >= min_cover) | F.col("long"))
            .select(F.col("id").alias("doc_id"), "item_id", "hits", "coverage", "changed"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, best item, its coverage, re-parameterised or not."""
    per_doc = leaks(docs, benchmark).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.max(F.struct("coverage", F.negate("item_id").alias("no"), "changed")).alias("best"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(
        per_doc.withColumnRenamed("doc_id", "found"), F.col("doc_id").eqNullSafe(F.col("found")), "left")
    return out.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"),
                      F.coalesce("n_items", F.lit(0)).alias("n_items"), (-F.col("best.no")).alias("item_id"),
                      F.coalesce("best.coverage", F.lit(0.0)).alias("coverage"),
                      F.coalesce("best.changed", F.lit(False)).alias("reparameterised"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item (null ids stay)."""
    bad = leaks(docs, benchmark).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
