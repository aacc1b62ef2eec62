"""Merging blocks into one row per county (J7-J9) and attaching state
variables (J8); whole exports X1/X2.

The reference merges wide blocks with repeated full outer joins; a row
exists if any block has it and names come from the first block. Here every
block is keyed by ``county_key`` only; the spine supplies names once and
each block is left-joined to it. Rows kept: counties of at least one
block (a dense block - the question matrix - holds every county of the
scope). Same rows and measures as the reference; names are always filled
(deviation: the reference leaves them NULL for rows only a later block has).

All joins are on ``county_key``: blocks come out of their aggregate
hash-partitioned on it, so the chain of joins needs no further exchange of
the blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionpanel.functions.keys import in_list, qcol, quote, select_sql, zero_fill_sql
from regionpanel.operators.dimension import county_dimension, scoped_states
from regionpanel.operators.scores import Block
from regionpanel.plans.spec import Scope
from regionpanel.sources.schema import META
from regionpanel.sources.tables import Tables


def assemble_counties(tables: Tables, scope: Scope, blocks: list[Block],
                      state_columns: list[str] | None = None) -> DataFrame:
    """Spine + blocks (+ state variables) -> META + block columns in order.

    A column name already taken by an earlier block is dropped from the
    later one before its join (J9: the first wins), so no join ever carries
    two columns of one name."""
    spine = county_dimension(tables, scope)
    df = spine
    keep = F.lit(False)
    out, seen = [], set(META) | set(spine.columns)
    cells, slots = [], {}                       # long detail cells pivoted at the end
    for i, b in enumerate(blocks):
        present = f"_present{i}"
        fresh = [c for c in b.columns if c not in seen]
        seen.update(fresh)
        extra = [b.marker] if b.marker else []
        from_cells = {lbl: q for q, lbl in (b.cell_labels or {}).items() if lbl in fresh}
        if from_cells:
            cells.append(b.cells.where(in_list("question_id", list(from_cells.values()))))
            slots.update(from_cells)
        narrow = [c for c in fresh if c not in from_cells]
        frame = select_sql(b.frame, ["county_key", *[quote(c) for c in extra + narrow]])
        df = df.join(frame.withColumn(present, F.lit(True)), "county_key", "left")
        if b.dense:
            keep = F.lit(True)
        elif b.marker:
            keep = keep | F.coalesce(F.col(b.marker), F.lit(False))
        else:
            keep = keep | F.col(present).isNotNull()
        zero = set(b.zero_cols)
        out += [zero_fill_sql(quote(str(from_cells[c])), c) if c in from_cells
                else f"coalesce({quote(c)}, 0.0) AS {quote(c)}" if c in zero else quote(c) for c in fresh]
    if blocks:
        df = df.where(keep)
    if state_columns:
        fresh = [c for c in dict.fromkeys(state_columns) if c not in seen]
        sw = tables.state_wide.select("state_key", *[qcol(c) for c in fresh])
        df = df.join(sw, "state_key", "left")
        out += [quote(c) for c in fresh]
    if cells:
        # one row per county already; the long cells join on county_key and
        # the pivot groups by that row (its partitioning is the join's)
        long = cells[0]
        for c in cells[1:]:
            long = long.unionByName(c)
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.withColumn("_row", F.monotonically_increasing_id())  # alike rows stay apart
        joined = df.repartition(n, "county_key").join(long.repartition(n, "county_key"), "county_key", "left")
        df = joined.groupBy(*[qcol(c) for c in df.columns]).pivot("question_id", sorted(set(slots.values()))) \
            .agg(F.first("_v"))
    return select_sql(df, [*META, *out])


def merge_outer(left: DataFrame, right: DataFrame, on=("state_id", "county_id")) -> DataFrame:
    """Literal J7: full outer merge, left value wins for shared columns, no
    coalesce (a right-only row keeps NULL in the left's shared columns);
    right duplicates dropped before the join (J9)."""
    on = list(on)
    shared = [c for c in right.columns if c in set(left.columns) and c not in on]
    return left.join(right.drop(*shared), on, "full")


def merge_all(blocks: list[DataFrame], on=("state_id", "county_id")) -> DataFrame:
    """J7 over any number of blocks in ONE shuffle: what successive
    ``merge_outer`` calls from left to right give for blocks with one row per key.

    Every block becomes rows of (keys, block number, its own measures as one
    struct, null in the place of every other block's); their union is grouped
    by the keys once and the structs are opened again. A column that several
    blocks have is taken from the first of them only (J9); a row that only
    later blocks have keeps NULL there. Rows of NULL keys meet, as in the
    reference's merge. A key twice in one block would multiply rows there; here
    it fails the job."""
    on = list(on)
    if not blocks:
        raise ValueError("no blocks to merge")
    seen, owned = set(on), []
    for b in blocks:
        owned.append([c for c in b.columns if c not in seen])
        seen.update(owned[-1])
    bodies = [F.struct(*[qcol(c).alias(f"c{j}") for j, c in enumerate(cols)], F.lit(True).alias("here")) for cols in owned]
    kinds = [b.select(body.alias("x")).schema["x"].dataType for b, body in zip(blocks, bodies)]
    key = [f"_k{i}" for i in range(len(on))]
    tagged = None
    for i, b in enumerate(blocks):
        rows = b.select(*[qcol(c).alias(k) for c, k in zip(on, key)],
                        *[bodies[i].alias(f"_b{j}") if i == j else F.lit(None).cast(kind).alias(f"_b{j}") for j, kind in enumerate(kinds)])
        tagged = rows if tagged is None else tagged.unionByName(rows)
    merged = tagged.groupBy(*key).agg(*[x for j in range(len(blocks)) for x in (
        F.first(f"_b{j}", ignorenulls=True).alias(f"_b{j}"), F.count(f"_b{j}").alias(f"_n{j}"))])
    once = F.greatest(*[f"_n{j}" for j in range(len(blocks))], F.lit(0)) <= 1
    checked = merged.where(F.when(once, F.lit(True)).otherwise(F.raise_error(F.lit(f"a block has two rows of one {', '.join(on)}")).cast("boolean")))
    return checked.select(*[F.col(k).alias(c) for c, k in zip(on, key)],
                          *[F.col(f"_b{i}.c{j}").alias(c) for i, cols in enumerate(owned) for j, c in enumerate(cols)])


def attach_state(df: DataFrame, state_frame: DataFrame, on: str = "state_id") -> DataFrame:
    """State variables onto county rows; rows without state data kept."""
    shared = [c for c in state_frame.columns if c in set(df.columns) and c != on]
    return df.join(state_frame.drop(*shared), on, "left")


def state_frame(tables: Tables, scope: Scope, columns: list[str]) -> DataFrame:
    """The state block alone: state_id + chosen columns for the states of the
    scope (for a county scope: the states of those counties, L2)."""
    from regionpanel.operators.wide import state_wide_select

    if scope.kind == "county":
        keys = county_dimension(tables, scope).select("state_key")
    elif scope.all_states:
        keys = None
    else:
        keys = scoped_states(tables, scope).select("state_key")
    return state_wide_select(tables, keys, columns)
