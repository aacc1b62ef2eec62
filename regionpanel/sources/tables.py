"""The star schema as a record of DataFrames, canonicalised once at load.

Stored relations disagree on leading zeros (``'6'`` vs ``'06'``). ``Tables``
carries, for every relation, a stripped *key* (joins) and a padded *id*
(output), computed once here so that no later operator repeats the rule and
so that equality filters on plain key columns reach the Parquet reader.

Two ways in:

* ``Tables.from_stored(...)`` — stored-form DataFrames (an upstream system,
  the fixture mapping of the test tables);
* ``Tables.load(spark, path)`` — a canonical snapshot written by
  ``write_snapshot``. There the two fact tables also carry ``state_key`` and
  are partitioned by the padded ``state_id``, so a state-scoped export
  reads only its states' files, and rows are range-clustered by county so that Parquet min/max
  statistics skip row groups for county-scoped exports. With ``layout="bucketed"``
  the facts are bucketed and sorted by ``county_key`` instead: an aggregate by
  county then needs no exchange. Rows of *hot* counties (more than
  ``HOT_BUCKETS`` average buckets each) lie apart, unbucketed, so that no
  bucket holds one; they are aggregated as any frame is and put beside the rest.
"""

from __future__ import annotations

import hashlib
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionpanel.functions.keys import COUNTY_WIDTH, STATE_WIDTH, pad_code, strip_code
from regionpanel.functions.measures import measure, score
from regionpanel.sources import schema as S


@dataclass(frozen=True)
class Tables:
    """Canonical relations.

    states            state_key, state_id, state_name, abbrev
    counties          county_key, state_key, county_id, county_name
    census_variables  variable_id, variable_name
    census_facts      county_key, variable_id, value (double)   [+ state_key, state_id]
    questions         question_id, question, category
    responses         county_key, question_id, value (double) [+ state_key, state_id, category]
    state_wide        state_key, state_id, <measures in stored order>
    header_dictionary ordinal, name, header  (may be None)
    """

    states: DataFrame
    counties: DataFrame
    census_variables: DataFrame
    census_facts: DataFrame
    questions: DataFrame
    responses: DataFrame
    state_wide: DataFrame
    header_dictionary: DataFrame | None = None
    strict_measures: bool = True
    # request-bounded dictionary lookups already collected (driver side)
    _memo: dict = field(default_factory=dict, compare=False, repr=False)
    # bucketed layout: relation -> (its whole frame, frames without a common county)
    _apart: dict = field(default_factory=dict, compare=False, repr=False)
    # loaded snapshot: the questions whose categories the responses carry
    _categories: DataFrame | None = field(default=None, compare=False, repr=False)

    def memo(self, key, compute):
        """Cached small driver-side lookup (dictionary rows of one request).

        A snapshot is read-only, so a lookup answered once stays valid, like
        the reference's preloaded catalogues."""
        if key not in self._memo:
            self._memo[key] = compute()
        return self._memo[key]

    # ------------------------------------------------------------ construction

    @classmethod
    def from_stored(
        cls,
        states: DataFrame,
        counties: DataFrame,
        census_variables: DataFrame,
        census_facts: DataFrame,
        questions: DataFrame,
        responses: DataFrame,
        state_wide: DataFrame,
        header_dictionary: DataFrame | None = None,
        state_key_column: str = "state_id",
        strict_measures: bool = True,
    ) -> "Tables":
        st = states.select(
            strip_code("state_id").alias("state_key"),
            pad_code(strip_code("state_id"), STATE_WIDTH).alias("state_id"),
            F.col("name").alias("state_name"),
            F.col("abbrev"),
        )
        co = counties.select(
            strip_code("county_id").alias("county_key"),
            strip_code("state_id").alias("state_key"),
            pad_code(strip_code("county_id"), COUNTY_WIDTH).alias("county_id"),
            F.col("name").alias("county_name"),
        )
        cv = census_variables.select(
            F.col("variable_id").cast("int").alias("variable_id"),
            F.col("name").alias("variable_name"),
        )
        cf = census_facts.select(
            strip_code("county_id").alias("county_key"),
            F.col("variable_id").cast("int").alias("variable_id"),
            measure("data", strict_measures).alias("value"),
        )
        qu = questions.select(
            F.col("question_id").cast("long").alias("question_id"),
            F.col("question"),
            F.col("category"),
        )
        rs = responses.select(
            strip_code("county_id").alias("county_key"),
            F.col("question_id").cast("long").alias("question_id"),
            score("value", strict_measures).alias("value"),
        )
        measures = [c for c in state_wide.columns if c.lower() != state_key_column.lower()]
        sw = state_wide.select(
            strip_code(F.col(state_key_column)).alias("state_key"),
            pad_code(strip_code(F.col(state_key_column)), STATE_WIDTH).alias("state_id"),
            *[F.col(f"`{m}`") for m in measures],
        )
        return cls(st, co, cv, cf, qu, rs, sw, header_dictionary, strict_measures)

    @staticmethod
    def measure_rejects(census_facts: DataFrame, responses: DataFrame) -> DataFrame:
        """Stored facts whose measure text does not cast (K7): one row per
        relation with the reject count, one aggregate each (partial counts
        map side). Use before loading with ``strict_measures=False``."""
        from regionpanel.functions.measures import SCORE_TYPE, rejected

        cf = census_facts.agg(F.count(F.when(rejected("data"), 1)).alias("n_rejected")) \
            .select(F.lit("census_facts").alias("relation"), "n_rejected")
        rs = responses.agg(F.count(F.when(rejected("value", SCORE_TYPE), 1)).alias("n_rejected")) \
            .select(F.lit("responses").alias("relation"), "n_rejected")
        return cf.unionByName(rs)

    def with_header_dictionary(self, dictionary: DataFrame) -> "Tables":
        return replace(self, header_dictionary=dictionary, _memo={})

    # ---------------------------------------------------------------- facts

    def state_variable_columns(self) -> list[str]:
        """Measures of the wide state table (S4): every column but the key."""
        return [c for c in self.state_wide.columns if c not in ("state_key", "state_id")]

    def check_keys(self) -> None:
        """One row per county and per state key, else ``ValueError`` (a code
        stored in two forms, ``6037`` and ``06037``, is one key): a repeated
        key would repeat every measure of its county. Two small aggregates."""
        for name, key in (("counties", "county_key"), ("states", "state_key")):
            twice = (getattr(self, name).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(3).collect())
            if twice:
                raise ValueError(f"{name}: repeated {key} {sorted(str(r[key]) for r in twice)}")

    def county_parts(self, name: str) -> list[DataFrame]:
        """Frames that make up a fact relation and share no county: an
        aggregate by county may be taken of each by itself."""
        whole = getattr(self, name)
        kept, parts = self._apart.get(name, (None, [whole]))
        return parts if kept is whole else [whole]

    # -------------------------------------------------------------- snapshot

    def write_snapshot(self, path: str, partitions: int | None = None, layout: str = "state") -> None:
        """Write a canonical snapshot (Parquet).

        Facts get ``state_key`` by one join with the county dimension and are
        written partitioned by the padded ``state_id`` (never empty, unlike
        the key of state ``0``, which Hive-style paths would turn into NULL).
        Inside a state, rows lie by ranges of counties, which makes min/max
        statistics useful; a range with much data, such as a hot county's, is
        split over several files instead of one task. ``partitions`` sets the
        number of county ranges; by default one for each 256 MB that
        the facts' input files hold, and ``spark.sql.shuffle.partitions`` at least.

        ``layout="bucketed"`` writes the facts in that many buckets of
        ``county_key`` instead (see the module's text).

        A finished snapshot is never written over (``versions.SnapshotStore``
        publishes a new one beside it); what a broken write left is.
        """
        dims = {
            "states": self.states, "counties": self.counties,
            "census_variables": self.census_variables, "questions": self.questions,
            "state_wide": self.state_wide,
        }
        spark = self.states.sparkSession
        if _exists(spark, f"{path}/{MANIFEST}"):
            raise ValueError(f"{path} holds a finished snapshot; readers may be at work on it: write a new version "
                             "(regionpanel.sources.versions.SnapshotStore)")
        if layout not in ("state", "bucketed"):
            raise ValueError("layout must be 'state' or 'bucketed'")
        self.check_keys()
        notes = []
        for name, df in dims.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        if self.header_dictionary is not None:
            self.header_dictionary.write.mode("overwrite").parquet(f"{path}/header_dictionary")

        # responses carry their question's category (a read-only snapshot):
        # category sums then filter the scan instead of joining the dictionary;
        # those of a loaded snapshot carry it already, unless its questions were replaced
        responses = self.responses
        if self._categories is not self.questions or "category" not in responses.columns:
            categories = self.questions.select("question_id", "category")
            responses = responses.drop("category").join(categories, "question_id", "left")
        county_state = self.counties.select("county_key", "state_key").withColumn("state_id", pad_code("state_key", STATE_WIDTH))
        for name, df in (("census_facts", self.census_facts), ("responses", responses)):
            facts = df.drop("state_key", "state_id")
            n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_input_bytes(facts) // WRITE_BYTES))
            if layout == "bucketed":
                notes += _write_bucketed(facts.join(county_state, "county_key", "inner"), f"{path}/{name}", name, n)
                continue
            with _settings(spark, _write_settings(spark)):
                _by_place(facts, county_state, n).write.mode("overwrite").partitionBy("state_id").parquet(f"{path}/{name}")
        written = [*dims, "census_facts", "responses"] + (["header_dictionary"] if self.header_dictionary is not None else [])
        spark.createDataFrame([(r,) for r in sorted(written) + notes], "value string").coalesce(1).write.mode("overwrite") \
            .text(f"{path}/{MANIFEST}")

    @classmethod
    def read_stored(cls, spark: SparkSession, path: str, fmt: str = "parquet",
                    header_dictionary: DataFrame | None = None, strict_measures: bool = True) -> "Tables":
        """S1 from files: one folder per stored relation under ``path``
        (``states/``, ``counties/`` ...), read with the declared schemas (no
        inference, so a drifted file fails at read rather than mid-job); the
        wide state table keeps whatever measures it has."""
        def read(name, schema=None):
            r = spark.read.format(fmt)
            if fmt == "csv":
                r = r.option("header", True)
            if schema is not None:
                r = r.schema(schema)
            return r.load(f"{path}/{name}")

        stored = {name: read(name, schema) for name, schema in S.STORED.items()}
        state_wide = read("state_wide") if fmt != "csv" else \
            spark.read.option("header", True).option("inferSchema", True).csv(f"{path}/state_wide")
        return cls.from_stored(**stored, state_wide=state_wide.withColumn("state_id", F.col("state_id").cast("string")),
                               header_dictionary=header_dictionary, strict_measures=strict_measures)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Tables":
        """Read a snapshot written by ``write_snapshot`` (already canonical)."""
        read = lambda name: spark.read.parquet(f"{path}/{name}")

        def read_facts(name):
            # partition values are text: no type inference ('06' stays '06')
            inferred = read(name).schema
            fields = [f if f.name != "state_id" else T.StructField("state_id", T.StringType(), True)
                      for f in inferred.fields]
            return spark.read.schema(T.StructType(fields)).parquet(f"{path}/{name}")

        if not _exists(spark, f"{path}/{MANIFEST}"):
            raise ValueError(f"{path} holds no finished snapshot (no {MANIFEST})")
        listed = {r.value for r in spark.read.text(f"{path}/{MANIFEST}").collect()}
        header = read("header_dictionary") if "header_dictionary" in listed else None
        buckets = dict(note.split("=", 1)[1].split(":") for note in listed if note.startswith("buckets="))
        apart = {}
        for name in ("census_facts", "responses"):
            parts = [read_facts(name)] if name not in buckets else _read_bucketed(spark, f"{path}/{name}", int(buckets[name]))
            if f"hot={name}" in listed:
                parts.append(read_facts(f"{name}_hot"))
            apart[name] = (reduce(DataFrame.unionByName, parts), parts)
        questions = read("questions")
        t = cls(
            states=read("states"), counties=read("counties"),
            census_variables=read("census_variables"), census_facts=apart["census_facts"][0],
            questions=questions, responses=apart["responses"][0],
            state_wide=read("state_wide"), header_dictionary=header, _apart=apart, _categories=questions,
        )
        _check_columns(t)
        t.check_keys()
        return t


MANIFEST = "manifest"
WRITE_BYTES = 256 << 20
#: a county with more rows than so many average buckets is hot
HOT_BUCKETS = 2


def _by_place(facts: DataFrame, county_state: DataFrame, n: int) -> DataFrame:
    """Facts with their state, dealt out by ``n`` ranges of counties, in their order.

    The ranges are taken from the county dimension, which every fact meets
    anyway: ranges over the facts themselves would compute their joins twice,
    once to sample them. How many facts a range has shows when they have been
    shuffled; AQE then splits a large one and puts small ones together. A
    county's number in the order of states and counties sorts faster than two texts,
    and as the only sort column it is sorted by its bits, without a look at the rows."""
    order = ["state_id", "county_key"]
    placed = (county_state.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .select("*", F.spark_partition_id().alias("_place"), F.monotonically_increasing_id().alias("_number")))
    return (facts.join(placed, "county_key", "inner").hint("rebalance", n, "_place")
            .sortWithinPartitions("_number").drop("_place", "_number"))


#: states whose files a writing task holds open; with more it sorts the rest of its rows by state
OPEN_STATES = 64


def _write_settings(spark: SparkSession) -> dict[str, str]:
    """Settings of the facts' write by state: a task keeps the files of its states
    open, so that rows in county order need no second order by state; and a join
    whose smaller side is a few MB a partition hashes that side instead of sorting
    every fact."""
    return {"spark.sql.maxConcurrentOutputFileWriters": str(OPEN_STATES),
            "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """Session settings while the block runs."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _write_bucketed(facts: DataFrame, path: str, name: str, buckets: int) -> list[str]:
    """Facts in ``buckets`` sorted buckets of county_key, hot counties beside them; notes for the manifest.

    Fewer than ``buckets / HOT_BUCKETS`` counties can be hot, which bounds the
    list that is broadcast. The table entry made for the write is dropped; the
    files stay."""
    import uuid

    spark = facts.sparkSession
    per_county = facts.groupBy("county_key").agg(F.count(F.lit(1)).alias("n"))
    total = facts.count()
    hot = [r.county_key for r in per_county.where(F.col("n") > HOT_BUCKETS * total / buckets).select("county_key").collect()]
    cold = facts
    if hot:
        keys = F.broadcast(spark.createDataFrame([(k,) for k in hot], "county_key string"))
        cold = facts.join(keys, "county_key", "left_anti")
        hashed = F.xxhash64(*facts.columns)
        (facts.join(keys, "county_key", "left_semi").repartitionByRange(buckets, "county_key", hashed)
         .write.mode("overwrite").parquet(f"{path}_hot"))
    table = f"regionpanel_write_{uuid.uuid4().hex}"
    (cold.repartition(buckets, "county_key").write.mode("overwrite").option("path", path)
     .bucketBy(buckets, "county_key").sortBy("county_key").saveAsTable(table))
    spark.sql(f"DROP TABLE {table}")
    return [f"buckets={name}:{buckets}"] + ([f"hot={name}"] if hot else [])


def _read_bucketed(spark: SparkSession, path: str, buckets: int) -> list[DataFrame]:
    """The bucketed files under a table entry of this session, which tells Spark how they lie."""
    table = "regionpanel_" + hashlib.sha256(path.encode()).hexdigest()[:32]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY (county_key) SORTED BY (county_key) "
              f"INTO {buckets} BUCKETS LOCATION '{path}'")
    return [spark.table(table)]

_REQUIRED = {
    "states": {"state_key": "string", "state_id": "string", "state_name": "string", "abbrev": "string"},
    "counties": {"county_key": "string", "state_key": "string", "county_id": "string", "county_name": "string"},
    "census_variables": {"variable_id": "int", "variable_name": "string"},
    "census_facts": {"county_key": "string", "variable_id": "int", "value": "double"},
    "questions": {"question_id": "bigint", "question": "string", "category": "string"},
    "responses": {"county_key": "string", "question_id": "bigint", "value": "double"},
    "state_wide": {"state_key": "string", "state_id": "string"},
}


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _input_bytes(df: DataFrame) -> int:
    """Bytes of the files a frame reads (folder summaries, not one call per file)."""
    spark = df.sparkSession
    total = 0
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p, fs = _path(spark, folder)
        total += fs.getContentSummary(p).getLength()
    return total


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def _check_columns(t: Tables) -> None:
    """A snapshot that misses a column, or holds one of another type, fails
    here, not half way through a job."""
    for name, need in _REQUIRED.items():
        have = dict(getattr(t, name).dtypes)
        wrong = {c: have.get(c) for c, kind in need.items() if have.get(c) != kind}
        if wrong:
            raise ValueError(f"snapshot relation {name!r}: wrong or missing columns {wrong}")
