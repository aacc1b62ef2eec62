"""Toxicity: gradient-boosted trees over dense features, isotonic calibration.

Features of a text (one numpy pass per batch, no language, source or id):
densities of a fixed insult list, of insults written with digits or signs
(``1d10t``, ``st*pid``), and of words and word stems learnt from the labels;
insults within ``NEAR`` words of a second-person word; capitals, punctuation,
exclamation, symbol-in-word and repeated-character rates; length.

Learning uses only labelled rows with crc32(id as text) mod 5 <> 0, at most
``FIT_ROWS`` of them (smallest hashes of the id, so the sample is the same on
every run).  Words and stems get smoothed log-odds from document counts; the
trees see each row through the list learnt from the other half of the rows,
so they do not learn the list's own noise.  The list is a parameter of the model: of
the words and stems of the (at most ``FIT_ROWS``) learning rows the
``LEXICON_SIZE`` with the largest smoothed log-odds are kept; it bounds
what is learnt and sent to the tasks, not what is scored.  Rows with remainder 4 only fit the
isotonic calibration.  The trees and the calibration are Spark ML's.

Null text is empty and is scored like any other; without usable labels, or
with one class only, the score is that class's share (0.5 if none) and the
list and trees are skipped.  A null id is never held out and never learnt
from; a repeated labelled id takes its largest label.  Extra columns in the
tables are never read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as T
from .common import python_batches, release, staged

#: fixed values: common insults and second-person words
INSULTS = ("idiot idiots moron morons stupid loser losers scum trash garbage pathetic worthless clown clowns disgusting "
           "dumb fool fools jerk ugly hate filthy vermin coward liar imbecile cretin dumbass bastard bitch asshole shit "
           "fuck fucking crap idiota imbécil estúpido basura asqueroso patético inútil idiote stupide dégoûtant ordure "
           "crétin pathétique dumm dummkopf trottel abschaum ekelhaft erbärmlich wertlos arschloch").split()
SECOND_PERSON = "you your yours yourself u ur tu te ti tus vosotros usted ustedes toi ton ta tes vous votre du dich dir dein deine euch ihr".split()
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

FIT_ROWS = 20_000
LEXICON_SIZE = 5_000
STEM_BYTES = 6
NEAR = 3
MIN_DOCS = 3
FEATURES = ["insults", "insult_count", "obfuscated", "near_second_person", "second_person", "learnt", "learnt_top",
            "learnt_share", "stem", "stem_share", "capitals", "punctuation", "exclamations", "symbols_inside", "repeats",
            "length"]

_U = np.uint64


def _hash_words(words) -> np.ndarray:
    raw = [w.encode() for w in words]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(w) for w in raw], out=offsets[1:])
    data = np.frombuffer(b"".join(raw), np.uint8)
    return np.sort(T.range_hash(T.prefix_hash(T.BYTE_CODES[data]), offsets[:-1], offsets[1:]))


_LEET_BYTES = T.LOWER.copy()
for _a, _b in LEET.items():
    _LEET_BYTES[ord(_a)] = ord(_b)
_LEET_WORD = T.WORD_ALNUM.copy()
for _a in "@$!*":
    _LEET_WORD[ord(_a)] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True
_INSULT_HASHES = _hash_words(INSULTS)
_SECOND_HASHES = _hash_words(SECOND_PERSON)


def _found(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _weights(values: np.ndarray, lexicon) -> np.ndarray:
    keys, weight = lexicon
    hit = _found(values, keys)
    out = np.zeros(len(values))
    out[hit] = weight[np.searchsorted(keys, values[hit])]
    return out


def _stems(words: T.Words) -> np.ndarray:
    """Hashes of the first bytes of each word, apart from word hashes; short words stand for themselves."""
    prefix = T.prefix_hash(T.BYTE_CODES[T.LOWER[words.data]])
    return ~T.range_hash(prefix, words.start, np.minimum(words.end, words.start + STEM_BYTES))


def _sum(doc: np.ndarray, n: int, values=None) -> np.ndarray:
    return np.bincount(doc, values, n).astype(float)


def feature_rows(data: np.ndarray, offsets: np.ndarray, word_list, stem_list) -> np.ndarray:
    """(documents, FEATURES) for the texts of one slice."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    byte_doc = np.repeat(np.arange(n), size)
    words = T.Words(data, offsets, T.WORD_ALNUM)
    per_word = np.maximum(words.counts, 1)
    per_byte = np.maximum(size, 1)
    insult = _found(words.hash, _INSULT_HASHES)
    second = _found(words.hash, _SECOND_HASHES)
    near = np.zeros(len(insult), bool)
    for step in range(1, NEAR + 1):
        if len(near) > step:
            same = words.doc[step:] == words.doc[:-step]
            near[step:] |= insult[step:] & second[:-step] & same
            near[:-step] |= insult[:-step] & second[step:] & same
    leet = T.Words(data, offsets, _LEET_WORD)
    plain = T.range_hash(T.prefix_hash(T.BYTE_CODES[_LEET_BYTES[data]]), leet.start, leet.end)
    hidden = _found(plain, _INSULT_HASHES) & ~_found(leet.hash, _INSULT_HASHES)
    learnt, stem = _weights(words.hash, word_list), _weights(_stems(words), stem_list)
    top = np.zeros(n)
    np.maximum.at(top, words.doc[learnt > 0], learnt[learnt > 0])
    letter, punct = _LETTER[data], _PUNCT[data]
    inside = np.zeros(len(data), bool)
    same = np.zeros(len(data), bool)
    if len(data) > 2:
        inside[1:-1] = ~letter[1:-1] & punct[1:-1] & letter[:-2] & letter[2:]
        same[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & letter[2:]
    letters = np.maximum(_sum(byte_doc[letter], n), 1)
    return np.stack([
        _sum(words.doc[insult], n) / per_word, np.log1p(_sum(words.doc[insult], n)), _sum(leet.doc[hidden], n) / per_word,
        _sum(words.doc[near], n) / per_word, _sum(words.doc[second], n) / per_word,
        _sum(words.doc, n, learnt) / per_word, top, _sum(words.doc[learnt > 0], n) / per_word,
        _sum(words.doc, n, stem) / per_word, _sum(words.doc[stem > 0], n) / per_word,
        _sum(byte_doc[_UPPER[data]], n) / letters, _sum(byte_doc[punct], n) / per_byte,
        _sum(byte_doc[data == 33], n) / per_byte, _sum(byte_doc[inside], n) / per_byte, _sum(byte_doc[same], n) / per_byte,
        np.log1p(words.counts)], 1)


def _featurise(lists: dict):
    """lists: for each value of ``part`` the (words, stems) to look through."""
    def run(batches):
        for batch in batches:
            data, offsets = T.text_column(batch)
            part = batch.column(batch.schema.get_field_index("part")).to_numpy(zero_copy_only=False)
            rows = np.zeros((batch.num_rows, len(FEATURES)))
            for i, j in T.slices(offsets):
                piece, off = T.slice_text(data, offsets, i, j)
                for p in np.unique(part[i:j]):
                    mine = part[i:j] == p
                    rows[i:j][mine] = feature_rows(piece, off, *lists[int(p)])[mine]
            keep = [k for k, name in enumerate(batch.schema.names) if name not in ("text", "part")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keep] + [pa.array(rows[:, f]) for f in range(len(FEATURES))],
                names=[batch.schema.names[k] for k in keep] + FEATURES)
    return run


def _units(batches):
    """Distinct words (kind 0) and stems (kind 1) of each labelled text."""
    for batch in batches:
        data, offsets = T.text_column(batch)
        toxic = batch.column(batch.schema.get_field_index("toxic")).to_numpy(zero_copy_only=False)
        half = batch.column(batch.schema.get_field_index("part")).to_numpy(zero_copy_only=False)
        for i, j in T.slices(offsets):
            words = T.Words(*T.slice_text(data, offsets, i, j), T.WORD_ALNUM)
            for kind, values in ((0, words.hash), (1, _stems(words))):
                doc, value, _ = T.distinct_per_doc(words.doc, values, j - i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(doc), kind, np.int32)), pa.array(value.astype(np.int64)),
                     pa.array(toxic[i:j][doc].astype(np.int32)), pa.array(half[i:j][doc].astype(np.int32))],
                    names=["kind", "unit", "toxic", "part"])


def _lexicon(counts, halves, n_pos: int, n_neg: int):
    """Smoothed log-odds of the units that mark toxic rows, as sorted arrays, for words and stems."""
    lists = []
    for kind in (0, 1):
        found = []
        for r in counts:
            if r["kind"] == kind:
                pos = sum(r[f"p{h}"] for h in halves)
                neg = sum(r[f"n{h}"] for h in halves)
                score = math.log((pos + 0.5) / (n_pos + 1.0)) - math.log((neg + 0.5) / (n_neg + 1.0))
                if pos >= MIN_DOCS and score > 1.5:
                    found.append((score, r["unit"]))
        found = sorted(found, reverse=True)[:LEXICON_SIZE]
        keys = np.array([u for _, u in found], np.int64).astype(np.uint64)
        order = np.argsort(keys)
        lists.append((keys[order], np.array([s for s, _ in found])[order] if found else np.zeros(0)))
    return tuple(lists)


def fold(id_col) -> F.col:
    return F.crc32(id_col.cast("string").cast("binary")) % 5


def scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    python_batches(spark)
    docs = docs.select(F.col("doc_id"), F.col("text"))
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))

    # a bounded sample of labelled rows: at most fit_rows small rows, hence the broadcast
    sample = (labels.where("doc_id is not null and toxic is not null").where(fold(F.col("doc_id")) != 0)
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    fit = staged(docs.join(F.broadcast(sample), "doc_id")
                 .select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"), fold(F.col("doc_id")).alias("fold"))
                 .withColumn("part", F.when(F.col("fold") <= 2, 1).otherwise(0)), "labelled")
    sizes = {(r["part"], r["toxic"]): r["n"] for r in fit.groupBy("part", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    positive = sum(n for (_, t), n in sizes.items() if t)
    total = sum(sizes.values())
    flat = positive / total if total else 0.5
    per_fold = {(r["cal"], r["toxic"]) for r in fit.select((F.col("fold") == 4).alias("cal"), "toxic").distinct().collect()}
    if len(per_fold) < 4:
        release(fit)
        return docs.select("doc_id", held.alias("held_out"), F.lit(flat).alias("score"),
                           F.lit(int(flat >= 0.5)).alias("predicted"))

    # document counts of words and stems; a unit below the least count in every half never returns to the driver,
    # and the rows that do come from at most fit_rows texts
    counts = (fit.select("text", "toxic", "part").mapInArrow(_units, "kind int, unit long, toxic int, part int")
              .groupBy("kind", "unit").agg(*[F.sum(F.when((F.col("toxic") == t) & (F.col("part") == h), 1).otherwise(0)).alias(f"{'np'[t]}{h}")
                                             for t in (0, 1) for h in (0, 1)])
              .where(F.col("p0") + F.col("p1") >= MIN_DOCS)
              .where((F.col("p0") + F.col("p1") + 0.5) * (total - positive + 1.0) > 3.0 * (F.col("n0") + F.col("n1") + 0.5) * (positive + 1.0))
              .collect())
    n_of = lambda t, halves: sum(n for (h, x), n in sizes.items() if x == t and h in halves)
    lists = {h: _lexicon(counts, [1 - h], n_of(1, [1 - h]), n_of(0, [1 - h])) for h in (0, 1)}
    lists[2] = _lexicon(counts, [0, 1], n_of(1, [0, 1]), n_of(0, [0, 1]))

    columns = ", ".join(f"{f} double" for f in FEATURES)
    seen = staged(fit.select("text", "part", "toxic", "fold")
                  .mapInArrow(_featurise(lists), f"toxic int, fold long, {columns}"), "fit-features")
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
    trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=20, maxDepth=3, stepSize=0.3, maxBins=32,
                          seed=1, checkpointInterval=-1)
    known = assemble.transform(seen.withColumn("label", F.col("toxic").cast("double"))).select("features", "label", "fold")
    model = trees.fit(known.where("fold <> 4").coalesce(4))
    raw = lambda df: model.transform(df).withColumn("p", vector_to_array("probability")[1])
    curve = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="iso").fit(
        raw(known.where("fold = 4")).select("p", "label"))
    release(fit, seen)
    rows = docs.select("doc_id", held.alias("held_out"), "text", F.lit(2).alias("part")).mapInArrow(
        _featurise(lists), f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, {columns}")
    # the curve is a staircase: a little of the raw probability keeps the order inside a step
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.98 * F.col("iso") + 0.02 * F.col("p")))
    return (curve.transform(raw(assemble.transform(rows))).withColumn("score", score)
            .select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` scored below 0.5 (rows sharing an id are judged together)."""
    bad = scores(docs, labels).where("predicted = 1").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
