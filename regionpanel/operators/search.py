"""Indexed substring search over a catalogue.

``catalogue_search`` reads every text. The index is a table of positional
trigrams: for each place of a lower-cased text the three characters that start
there (past the end: NUL), the row's id and the places. It is partitioned by the
first character's hash and sorted by trigram, so a search reads the postings of
its own trigrams only.

A query of three or more characters is cut into trigrams that cover all of its
characters (every third one and the last). A row holds the query at place p
exactly if it has each of them at p plus its offset: postings are shifted,
intersected by (id, place) and counted, and what is found is the answer - the
places take the part of a look at the text. A query of one or two characters is
the beginning of the trigrams that start with it. An empty query matches every
row, and one with NUL characters reads the texts, as ``catalogue_search`` does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionpanel.functions.keys import in_list, quote
from regionpanel.operators.dimension import IN_LIST_LIMIT
from regionpanel.operators.lookups import catalogue_search

PARTS = 64
NUL = "\x00"


def _part(column):
    return F.pmod(F.xxhash64(F.substring(column, 1, 1)), F.lit(PARTS)).cast("int")


def postings(catalogue: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(part, gram, id, places): one row per trigram of a row's lower-cased text."""
    text = F.lower(F.col(quote(text_col)))
    padded = F.concat(text, F.lit(NUL + NUL))
    places = catalogue.where(F.length(text) > 0).select(
        F.col(quote(id_col)).alias("id"), padded.alias("t"),
        F.explode(F.sequence(F.lit(0), F.length(text) - 1)).alias("place"))
    grams = places.select("id", F.expr("substring(t, place + 1, 3)").alias("gram"), "place")
    return (grams.groupBy("gram", "id").agg(F.array_sort(F.collect_list("place")).alias("places"))
            .select(_part("gram").alias("part"), "gram", "id", "places"))


def write_index(catalogue: DataFrame, path: str, id_col: str, text_col: str) -> None:
    (postings(catalogue, id_col, text_col).repartitionByRange("part", "gram", "id").sortWithinPartitions("part", "gram")
     .write.mode("overwrite").partitionBy("part").parquet(path))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _own_parts(index: DataFrame, starts: list[str]) -> list[int]:
    """Partitions of first characters: a few hashes, taken by Spark so that they are the index's own."""
    spark = index.sparkSession
    rows = spark.createDataFrame([(s,) for s in starts], "gram string").select(_part("gram").alias("part")).distinct().collect()
    return [r.part for r in rows]


def query_text(query: str | None) -> str:
    return (query or "").strip().lower()


def search_places(index: DataFrame, query: str) -> DataFrame:
    """(id, first_place, n_places) of the rows that hold the query, from the postings alone."""
    q = query_text(query)
    if not q or NUL in q:
        raise ValueError("an empty query, or one with NUL characters, is no search of the index")
    if len(q) < 3:
        hit = index.where(in_list("part", _own_parts(index, [q])) & F.col("gram").startswith(q))
        found = hit.select("id", F.explode("places").alias("place"))
    else:
        offsets = sorted({*range(0, len(q) - 2, 3), len(q) - 3})
        grams = [(q[o:o + 3], o) for o in offsets]
        wanted = sorted({g for g, _ in grams})
        hit = index.where(in_list("part", _own_parts(index, wanted)) & in_list("gram", wanted))
        shifts = F.create_map(*[x for g in wanted for x in (F.lit(g), F.array(*[F.lit(o) for h, o in grams if h == g]))])
        starts = (hit.select("id", F.explode("places").alias("place"), shifts[F.col("gram")].alias("shifts"))
                  .select("id", "place", F.explode("shifts").alias("shift")).where("place >= shift")
                  .select("id", (F.col("place") - F.col("shift")).alias("place")))
        # a row has one trigram at a place, so a start is counted once for each offset
        found = starts.groupBy("id", "place").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams))
    return found.groupBy("id").agg(F.min("place").alias("first_place"), F.count(F.lit(1)).alias("n_places"))


def indexed_search(catalogue: DataFrame, index: DataFrame, id_col: str, text_col: str, query: str) -> DataFrame:
    """``catalogue_search`` by the index: few matches are fetched by an ``IN`` that
    the reader gets, many by a semi join on the id."""
    q = query_text(query)
    if not q or NUL in q:
        return catalogue_search(catalogue, text_col, query)
    ids = search_places(index, query).select("id")
    few = ids.limit(IN_LIST_LIMIT + 1).collect()
    if len(few) <= IN_LIST_LIMIT:
        return catalogue.where(in_list(id_col, [r.id for r in few]))
    return catalogue.join(ids.withColumnRenamed("id", id_col), id_col, "left_semi").select(*catalogue.columns)
