"""Target-distribution importance resampling over hashed n-gram features.

A text is a bag of n-grams of 1 to ``ngrams`` words, each hashed to one of
``buckets``.  A bucket that the target texts fill more than the corpus does
has a positive gain, one that they fill less a negative one; a document's
weight is the floored mean gain of its features, and the documents with the
highest weight plus Gumbel noise are a sample without replacement drawn in
proportion to the weights.

* **Words.**  One 256-byte table lower-cases A-Z and blanks every ASCII byte
  that is no letter or digit in the UTF-8 bytes; ``bytes.split`` gives the words.
* **Features.**  ``zlib.crc32`` of a word; the checksum of a longer run goes on
  from that of the run without its last word, so no n-gram string is made.
* **Counts.**  A Counter of buckets per task, summed by bucket in Spark: at most
  ``buckets`` rows a task, and ``buckets`` rows (the parameter) on the driver.
* **Drawing.**  Scores are written once.  A histogram of score bands (their
  number is bounded by the range of the logarithms) gives the band that holds
  the last drawn score; only documents from it upwards are sorted, by range,
  and a row's rank is its place in its part plus the sizes of the parts before.

Null or empty text: no features, weight 0, never drawn below ``min_words`` = 0.
Whole texts count, whatever their length.  Ties in score go to the smaller id,
a null id after all others; its noise is that of an empty id.  Repeated rows
count, score and rank each on its own.  Empty documents give an empty result,
an empty target (T = 0) gains that only say how rare a bucket is.  Extra
columns are never read.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, python_batches, staged

BUCKETS = 10_000
PERCENT = 10
MIN_WORDS = 20
SEED = "2024"
#: scores in a band of the histogram
BAND = 16

#: lower-cases A-Z, keeps digits, a-z and bytes of other characters, blanks the rest
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def features(words: list[bytes], ngrams: int, buckets: int) -> list[int]:
    """Bucket of every run of 1 to ``ngrams`` consecutive words, repeats included."""
    seeds = [crc32(w) for w in words]
    out = [s % buckets for s in seeds]
    for k in range(1, ngrams):
        seeds = [crc32(b" " + w, s) for w, s in zip(words[k:], seeds)]
        out += [s % buckets for s in seeds]
    return out


def _texts(batch: pa.RecordBatch):
    column = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
    return (x.as_py() or b"" for x in column)


def _bucket_counts(ngrams: int, buckets: int):
    def run(batches):
        counts = Counter()
        for batch in batches:
            for text in _texts(batch):
                counts.update(features(words_of(text), ngrams, buckets))
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(counts.keys(), pa.int32()), "n": pa.array(counts.values(), pa.int64())})
    return run


def bucket_counts(texts: DataFrame, ngrams: int = 1, buckets: int = BUCKETS, text_col: str = "text") -> dict[int, int]:
    """Features in each bucket over all rows."""
    python_batches(texts.sparkSession)
    rows = (texts.select(F.col(text_col).alias("text")).mapInArrow(_bucket_counts(ngrams, buckets), "bucket int, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    return {r.bucket: r.n for r in rows}


def bucket_gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """floor(1000 * ln) of the smoothed share in the target over that in the corpus."""
    s_all, t_all = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log(float(target.get(b, 0) + 1) * s_all / (float(corpus.get(b, 0) + 1) * t_all)))
            for b in range(buckets)]


def noise(seed: str, doc_id) -> int:
    """floor(1000 * Gumbel noise), the same for an id wherever it is drawn."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _score(gains, ngrams: int, seed: str):
    def run(batches):
        table = gains.value
        for batch in batches:
            out = {"n_words": [], "n_features": [], "weight": [], "score": []}
            for doc_id, text in zip(batch.column(0).to_pylist(), _texts(batch)):
                words = words_of(text)
                found = features(words, ngrams, len(table))
                weight = sum(map(table.__getitem__, found)) // len(found) if found else 0
                for name, value in zip(out, (len(words), len(found), weight, weight + noise(seed, doc_id))):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, pa.int64()) for v in out.values()]], names=["doc_id", *out])
    return run


def importance(docs: DataFrame, target: DataFrame, ngrams: int = 1, buckets: int = BUCKETS, seed: str = SEED,
               id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score."""
    spark: SparkSession = docs.sparkSession
    table = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    gains = bucket_gains(bucket_counts(table, ngrams, buckets), bucket_counts(target, ngrams, buckets, target_col), buckets)
    return table.mapInArrow(_score(spark.sparkContext.broadcast(gains), ngrams, seed),
                            "doc_id long, n_words long, n_features long, weight long, score long")


def draw(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, ... for the drawn documents, highest score first, null for the others.
    ``scored`` is read several times: a written table."""
    spark = scored.sparkSession
    asked = F.coalesce(F.col("n_words") >= min_words, F.lit(False))
    band = F.floor(F.col("score") / BAND)
    bands = sorted(scored.where(asked).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    wanted = sum(r.n for r in bands) * percent // 100
    seen, lowest = 0, None
    for r in bands:
        if seen >= wanted:
            break
        seen, lowest = seen + r.n, r.band
    none = F.lit(None).cast("long")
    if lowest is None:
        return scored.withColumn("rank", none)
    chosen = asked & (band >= lowest)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = staged(scored.where(chosen).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
                    .withColumn("part", F.spark_partition_id()).withColumn("place", place), "drawn")
    before, starts = 0, []
    for r in sorted(placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()):  # a row for each part
        starts.append((r.part, before))
        before += r.n
    starts = spark.createDataFrame(starts, "part int, before long")
    rank = F.col("before") + F.col("place") + 1
    ranked = placed.join(F.broadcast(starts), "part").select(*scored.columns, F.when(rank <= wanted, rank).alias("rank"))
    return ranked.unionByName(scored.where(~chosen).withColumn("rank", none))


def resample(docs: DataFrame, target: DataFrame, ngrams: int = 1, buckets: int = BUCKETS, percent: int = PERCENT,
             min_words: int = MIN_WORDS, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, rank (null where not drawn)."""
    return draw(staged(importance(docs, target, ngrams, buckets, seed), "importance"), percent, min_words)


def oracle(buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: str = SEED) -> str:
    """DuckDB SQL of the one-word case: CRC-32 byte by byte over the distinct words."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), " \
            "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    digit = "(instr('0123456789ABCDEF', substr(x, {at}, 1)) - 1)"
    return f"""
WITH crc AS (SELECT list(list_reduce(list_concat([i::BIGINT], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT doc_id, unnest({words}) AS w FROM documents),
b AS (SELECT unnest({words}) AS w FROM benchmark),
v AS (SELECT DISTINCT w, hex(encode(w)) AS x FROM (SELECT w FROM d UNION SELECT w FROM b)),
h AS (SELECT w, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(x) // 2),
          lambda k: ({digit.format(at='(2 * k + 1)::BIGINT')} * 16 + {digit.format(at='(2 * k + 2)::BIGINT')})::BIGINT)),
          lambda c, y: xor(c // 256, t[xor(c % 256, y) + 1])), 4294967295) % {buckets} AS bucket FROM v, crc),
s AS (SELECT bucket, count(*) AS s FROM d JOIN h USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN h USING (w) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM d) + {buckets})::DOUBLE
          / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b) + {buckets})::DOUBLE))) AS gain
      FROM (SELECT DISTINCT bucket FROM h) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
f AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM d JOIN h USING (w) JOIN g USING (bucket) GROUP BY doc_id),
z AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             list_reduce(list_concat([0::BIGINT], list_transform(range(8), lambda k: instr('0123456789abcdef',
                 substr(sha256('{seed}:' || doc_id), (k + 1)::BIGINT, 1)) - 1)), lambda a, y: a * 16 + y) AS h
      FROM documents LEFT JOIN f USING (doc_id)),
q AS (SELECT doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM z),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM q WHERE n_features >= {min_words})
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= n * {percent} // 100 THEN rank END AS rank
FROM q LEFT JOIN r USING (doc_id)"""
