"""Small tables with the awkward rows every operator must take."""

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # extra columns whose names clash with the operators' own
    T.StructField("score", T.StringType()), T.StructField("id", T.StringType()), T.StructField("kind", T.IntegerType())])

STORY = ("It was a quiet evening in the old harbour town when the last ferry came in and nobody left it but a tall man "
         "with a wooden box under his arm who asked the way to the lighthouse")
OTHER = ("Every spring the river rises and takes a part of the lower meadow with it so the farmers move their fences "
         "back a little further and say that the land will be given back some day")


def rows():
    long = " ".join(f"word{i}" for i in range(20_000))
    texts = [(1, STORY + " and went on."), (2, STORY + " and went on."), (3, STORY + " and went off."), (4, OTHER),
             (5, None), (6, ""), (7, "   "), (8, "one"), (9, "one two three"), (10, long), (11, long + " tail"),
             (12, "Ünïcode täxt \U0001f600 " + OTHER), (13, "\x00 nul \x0b and\r\nbreaks"), (None, OTHER), (None, None), (14, "one"),
             (15, "one"), (15, "one"), (16, OTHER + " " + STORY)]
    return [(i, t, "en", None if i == 4 else f"src{(i or 0) % 3}", len(t or ""), "x", "y", 7) for i, t in texts]


def docs(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def plain(spark, texts):
    """documents from texts, ids from 1"""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", 7) for i, t in enumerate(texts, 1)], DOCS)
