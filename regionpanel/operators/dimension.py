"""The county spine (J1) and scope filters.

The spine is ``counties ⋈ states`` on the stripped state key, restricted to
the scope, carrying both keys and the four output columns. It is built once
per export; every block aggregates by ``county_key`` first and meets the
spine afterwards, so names never travel with facts through a shuffle.

Parameter lists (user input) become either a literal ``IN`` (pushed into
the Parquet reader) or, past ``IN_LIST_LIMIT`` items, a broadcast semi join
against a DataFrame of the list; past ``LIST_BROADCAST`` items a Bloom filter
of the list thins the rows out where they are scanned and the semi join
shuffles what is left.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionpanel.functions.keys import in_list
from regionpanel.plans.spec import Scope
from regionpanel.sources.tables import Tables

IN_LIST_LIMIT = 5000
LIST_BROADCAST = 1_000_000
SPINE_COLUMNS = ["state_key", "county_key", "state_id", "state_name", "county_id", "county_name"]


def keep_keys(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows of ``df`` whose ``column`` is in ``values`` (J3; duplicates in
    ``values`` never multiply rows)."""
    values = sorted(set(values))
    if len(values) <= IN_LIST_LIMIT:
        return df.where(in_list(column, values))
    ids = df.sparkSession.createDataFrame([(v,) for v in values], [column])
    return keep_listed(df, column, ids, len(values))


BLOOM_BITS = 12
BLOOM_MOST = 1 << 26
BLOOM_HASHES = 6


def bloom_size(n: int) -> int:
    """Bits for ``n`` keys: ``BLOOM_BITS`` each (about 1 % false hits), a multiple
    of 64, at most ``BLOOM_MOST`` (8 MB) - more keys then pass more rows, no row is lost."""
    return -(-min(max(64, n * BLOOM_BITS), BLOOM_MOST) // 64) * 64


def _bloom_places(key, bits: int) -> list:
    one, two = F.pmod(F.xxhash64(key), F.lit(bits)), F.pmod(F.xxhash64(key, F.lit("second")), F.lit(bits))
    return [F.pmod(one + two * i, F.lit(bits)) for i in range(BLOOM_HASHES)]


BLOOM_BLOCK = 1024


class Bloom(NamedTuple):
    bits: int
    words: Column  # array<bigint>, 64 bits each: a scalar subquery


def bloom_filter(ids: DataFrame, column: str, bits: int) -> Bloom:
    """The filter of the ids as a scalar subquery of ``bits / 8`` bytes. Bits are
    or-ed map-side by words of 64, the words (those without a bit too) are put in
    order by blocks; no plan or plan text holds them, the driver passes on at most
    ``BLOOM_MOST`` bits, whatever the number of ids."""
    at = ids.select(F.explode(F.array(*_bloom_places(F.col(column), bits))).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))
    every = ids.sparkSession.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("x"))
    words = at.select(F.expr("at div 64").alias("w"), bit.alias("x")).unionByName(every).groupBy("w").agg(F.bit_or("x").alias("x"))
    blocks = words.groupBy(F.expr(f"w div {BLOOM_BLOCK}").alias("b")).agg(F.sort_array(F.collect_list(F.struct("w", "x")))["x"].alias("xs"))
    return Bloom(bits, blocks.agg(F.flatten(F.sort_array(F.collect_list(F.struct("b", "xs")))["xs"]).alias("words")).scalar())


def might_hold(key, held: Bloom):
    """Whether the filter may hold the key: JVM expressions over the filter's words;
    the first bit that is not set ends the test of a row."""
    test = F.lit(True)
    for place in _bloom_places(key, held.bits):
        word = F.get(held.words, F.floor(place / 64).cast("int"))
        test = test & (F.call_function("shiftright", word, F.pmod(place, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return test


def keep_listed(df: DataFrame, column: str, ids: DataFrame, n: int | None = None) -> DataFrame:
    """Rows of ``df`` whose ``column`` is among the ids of a frame of any length.

    A short list (``n`` counted, at most ``LIST_BROADCAST``) is a broadcast semi
    join. A longer one would shuffle every row of ``df``: a Bloom filter of the
    list, sized from its count, is tested where ``df`` is scanned, and the
    shuffle semi join gets only what passes, about the matches."""
    ids = ids.select(F.col(column)).where(F.col(column).isNotNull()).distinct()
    n = ids.count() if n is None else n
    if n <= LIST_BROADCAST:
        return df.join(F.broadcast(ids), column, "left_semi")
    return df.where(might_hold(F.col(column), bloom_filter(ids, column, bloom_size(n)))).join(ids.hint("shuffle_merge"), column, "left_semi")


def scoped_states(tables: Tables, scope: Scope) -> DataFrame:
    """States of a state scope (by abbreviation) or all states."""
    st = tables.states
    if scope.kind == "state" and not scope.all_states:
        st = keep_keys(st, "abbrev", scope.abbrev_keys())
    return st


def county_dimension(tables: Tables, scope: Scope) -> DataFrame:
    """Spine of the scope: one row per county."""
    counties = tables.counties
    if scope.kind == "county":
        counties = keep_keys(counties, "county_key", scope.county_keys())
        states = tables.states
    else:
        states = scoped_states(tables, scope)
    return (
        counties.join(states.select("state_key", "state_id", "state_name"), "state_key", "inner")
        .select(*SPINE_COLUMNS)
    )


SCOPE_BROADCAST_ROWS = 1_000_000
SPINE_BROADCAST_ROWS = 200_000


def scope_size(tables: Tables, scope: Scope) -> int:
    """Counties in the scope: one count on the county dimension, memoised."""
    return tables.memo(("scope_size", scope), lambda: county_dimension(tables, scope).count())


def sized_spine(tables: Tables, scope: Scope) -> DataFrame:
    """The spine for an INNER join with a block: broadcast when a count
    proves it small (the block then keeps its partitioning and the spine is
    not shuffled), a plain shuffle-join side otherwise."""
    spine = county_dimension(tables, scope)
    return F.broadcast(spine) if scope_size(tables, scope) <= SPINE_BROADCAST_ROWS else spine


def scope_keys_if_small(tables: Tables, scope: Scope) -> DataFrame | None:
    """County keys of a state scope when their count is at most
    ``SCOPE_BROADCAST_ROWS`` (a count on the county dimension: the proven
    bound that allows a broadcast), else None. Memoised per scope."""
    if scope_size(tables, scope) > SCOPE_BROADCAST_ROWS:
        return None
    return county_dimension(tables, scope).select("county_key")


def scoped_facts(facts: DataFrame, tables: Tables, scope: Scope) -> DataFrame:
    """Cheapest exact pre-filter of a fact table for a scope.

    * county scope: the request bounds the keys -> ``IN`` / broadcast semi join;
    * state scope on a snapshot (facts carry ``state_key`` and the padded
      partition column ``state_id``): partition filter plus exact key filter;
    * state scope on un-partitioned facts: a broadcast semi join with the
      scope's county keys when their number is checked small — rows leave
      before the partial aggregate; otherwise none: the block is aggregated
      by county first (map-side partial aggregation collapses hot counties,
      only partial aggregates shuffle) and the inner join with the spine
      drops out-of-scope counties afterwards;
    * every state: no filter.
    """
    if scope.kind == "county":
        return keep_keys(facts, "county_key", scope.county_keys())
    if scope.all_states:
        return facts
    if "state_key" in facts.columns:
        rows = scoped_states(tables, scope).select("state_key", "state_id").collect()
        if "state_id" in facts.columns:
            facts = keep_keys(facts, "state_id", [r.state_id for r in rows])
        return keep_keys(facts, "state_key", [r.state_key for r in rows])
    keys = scope_keys_if_small(tables, scope)
    if keys is None:
        return facts
    return facts.join(F.broadcast(keys), "county_key", "left_semi")


def by_county(tables: Tables, relation: str, scope: Scope, block) -> DataFrame:
    """``block`` (facts -> one row per county) over a scoped fact relation: over
    each of its parts that share no county, put together."""
    parts = [block(scoped_facts(facts, tables, scope)) for facts in tables.county_parts(relation)]
    return reduce(DataFrame.unionByName, parts)
