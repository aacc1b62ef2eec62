"""Mixing sources to target weights by Pfair scheduling.

Time is a line of slots; a slot takes one block of ``block_rows`` rows of one
source.  A source of weight w gets for its j-th block the release time
floor(j / w) and the deadline ceil((j + 1) / w); earliest deadline first gives
each slot to a released block.  With weights that sum to 1 no block misses its
deadline, so at any slot a source is less than one block from its share.

Weights are exact: each is the integer ratio of its float, and release times
and deadlines are integer divisions.  Real weights have no short period, so the
driver walks the blocks once (one heap step a block, ``block_rows`` times fewer
than rows) and keeps only the state at every ``SEGMENT``-th slot; tasks walk the
segments again from these states and write the table (source, block, slot),
which joins the rows by hash cell.  A given ``cycle`` rounds the weights to
whole slots of a repeating cycle instead (largest remainders, at least one
each): shares are then less than a block off the rounded weights.

Rows of a source are shuffled by a hash of the row; positions inside a source
come from hash-range cells (a cell holds about ``CELL_ROWS`` rows of one
source, so a hot source is many cells), counts per cell and ranks in cells.
All rows stay.  When a source is exhausted its blocks fall away and the rest go
on by their releases and deadlines; ``in_mix`` marks the rows before the first
exhaustion, for which the target weights hold.

Default weights are count ** ``alpha`` (temperature); a given map of source to
weight may leave sources out, which get the smallest given weight.  A null
source is a source of its own.  Sources of weight 0 come after all others; a
negative weight, or none above 0, raises.  Rows equal in all columns are
interchangeable.  The driver holds one number per source (and per source and
segment); more than ``cycle`` / 2 sources raise if a cycle is given.  An empty
table gives an empty result; extra columns are kept, clashing ones too (own
columns have a prefix).
"""

from __future__ import annotations

import heapq
import itertools
import math
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions

SEGMENT = 10_000
BLOCK_ROWS = 16
ALPHA = 0.7
CELL_ROWS = 2_000


def integer_weights(weights: dict) -> dict:
    """Whole numbers in exactly the ratios of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    if min(exact.values()) < 0 or max(exact.values()) == 0:
        raise ValueError("weights must not be negative, and one must be above 0")
    scale = math.lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * scale) for s, x in exact.items()}


def walk(weights: list, blocks: list, state: tuple | None = None):
    """Earliest deadline first over the blocks of sources 0, 1, ...: yields the source of each slot.

    Before a slot is given, ``state`` can be read from the generator's second value: (blocks done
    by each source, clock, slot of the first exhaustion or None).  The walk may start from any such state."""
    total = sum(weights)
    done, clock, ended = (list(state[0]), state[1], state[2]) if state else ([0] * len(weights), 0, None)
    ready, later = [], []

    def offer(i):
        if weights[i] and (done[i] < blocks[i] or ended is None):
            heapq.heappush(later, (done[i] * total // weights[i], -(-(done[i] + 1) * total // weights[i]), i))

    for i in range(len(weights)):
        offer(i)
    while ready or later:
        if not ready:
            clock = max(clock, later[0][0])
        while later and later[0][0] <= clock:
            heapq.heappush(ready, heapq.heappop(later)[1:])
        i = ready[0][1]
        if done[i] >= blocks[i]:  # its slot falls away
            if ended is None:
                ended = sum(done)
            heapq.heappop(ready)
            continue
        yield i, (done, clock, ended)
        heapq.heappop(ready)
        done[i] += 1
        clock += 1
        offer(i)
    for i, w in enumerate(weights):
        while not w and done[i] < blocks[i]:
            if ended is None:
                ended = sum(done)
            yield i, (done, clock, ended)
            done[i] += 1


def _segments(weights: list, blocks: list, size: int) -> tuple[list, int]:
    """(the state at every ``size``-th slot, the slot of the first exhaustion)."""
    states, ended = [], None
    for slot, (_, (done, clock, ended)) in enumerate(walk(weights, blocks)):
        if slot % size == 0:
            states.append((slot, list(done), str(clock), ended))
    return states, sum(blocks) if ended is None else ended


def _walked(names: list, weights: list, blocks: list, size: int):
    """Rows (source, block, slot) of each segment."""
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                out_s, out_j = [], []
                for i, (done, _, _) in itertools.islice(walk(weights, blocks, (r["done"], int(r["clock"]), r["ended"])), size):
                    out_s.append(names[i])
                    out_j.append(done[i])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out_s, pa.string()), pa.array(out_j, pa.int64()),
                     pa.array(range(r["slot"], r["slot"] + len(out_s)), pa.int64())], names=["ts", "j", "slot"])
    return run


def cycle_shares(weights: dict, cycle: int) -> dict:
    """Whole slots per cycle: all slots by weight, largest remainders first, at least one each, summing to ``cycle``."""
    if len(weights) > cycle // 2:
        raise ValueError(f"{len(weights)} sources do not fit a cycle of {cycle} slots")
    exact, small = {s: Fraction(w) for s, w in weights.items()}, set()
    while True:  # sources with less than one slot get one, the others share the rest
        rest = sum(x for s, x in exact.items() if s not in small)
        fair = {s: x * (cycle - len(small)) / rest for s, x in exact.items() if s not in small}
        less = {s for s, x in fair.items() if x < 1}
        if not less:
            break
        small |= less
    share = dict.fromkeys(weights, 1) | {s: math.floor(x) for s, x in fair.items()}
    left = cycle - sum(share.values())
    for s in sorted(fair, key=lambda s: (math.floor(fair[s]) - fair[s], s))[:left]:
        share[s] += 1
    return share


def edf_cycle(share: dict) -> list:
    """The source of each slot of one cycle: earliest deadline first among released blocks."""
    cycle = sum(share.values())
    waiting = sorted((j * cycle // m, -(-(j + 1) * cycle // m), s, j) for s, m in share.items() for j in range(m))
    ready, out, at = [], [], 0
    for slot in range(cycle):
        while at < len(waiting) and waiting[at][0] <= slot:
            heapq.heappush(ready, waiting[at][1:])
            at += 1
        deadline, source, _ = heapq.heappop(ready)
        assert slot < deadline
        out.append(source)
    return out


def mix(docs: DataFrame, weights: dict | None = None, source_col: str = "source", block_rows: int = BLOCK_ROWS,
        alpha: float = ALPHA, cycle: int | None = None) -> DataFrame:
    """``docs`` with mix_position (0, 1, ...), mix_slot, mix_block and in_mix."""
    spark = docs.sparkSession
    order = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), order.alias("h"),
                       F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`").cast("string")), F.lit("")).alias("s"))
    counts = {r["s"]: r["n"] for r in rows.groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}
    out_names = [F.col(f"row.`{c}`") for c in docs.columns]
    if not counts:
        return docs.select("*", *[F.lit(0).cast("long").alias(c) for c in ("mix_position", "mix_slot", "mix_block")],
                           F.lit(True).alias("in_mix"))
    if weights is None:
        wanted = {s: n ** alpha for s, n in counts.items()}
    else:
        wanted = {s: weights.get(s[1:] if s else None, min(weights.values())) for s in counts}
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    cells = max(1, math.ceil(sum(counts.values()) / CELL_ROWS))
    # the hash range is cut evenly: cell order is hash order
    cell = F.floor((F.shiftright(F.col("h"), 33) + (1 << 30)) * F.lit(cells) / F.lit(1 << 31))
    rows = rows.withColumn("cell", cell)
    per_cell = rows.groupBy("s", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = per_cell.select(F.col("s").alias("cs"), F.col("cell").alias("cc"), (F.sum("n").over(
        Window.partitionBy("s").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("before"), "n")
    rank = F.row_number().over(Window.partitionBy("s", "cell").orderBy("h")) - 1
    if cycle is None:
        slots, horizon = _exact_slots(spark, wanted, blocks)
    else:
        slots, horizon = _cycle_slots(spark, wanted, blocks, cycle)
    # the slots of a cell's blocks, from its first block on
    first = F.floor(F.col("before") / block_rows)
    parts = before.withColumn("j", F.explode(F.sequence(first, F.floor((F.col("before") + F.col("n") - 1) / block_rows))))
    lists = (parts.join(slots, (F.col("cs") == F.col("ts")) & (F.col("j") == F.col("tj")))
             .groupBy("cs", "cc", "before").agg(F.array_sort(F.collect_list(F.struct("j", "slot"))).alias("slots")))
    placed = (rows.withColumn("rank", rank)
              .join(lists, (F.col("s") == F.col("cs")) & (F.col("cell") == F.col("cc")))
              .withColumn("at", F.col("before") + F.col("rank"))
              .withColumn("mix_block", F.floor(F.col("at") / block_rows))
              .withColumn("mix_slot", F.element_at("slots", (F.col("mix_block") - first + 1).cast("int"))["slot"])
              .drop("slots"))

    # dense positions: rows before each piece of the slot line, then the rank inside the piece
    piece_slots = max(1, CELL_ROWS // block_rows)
    placed = placed.withColumn("piece", F.floor(F.col("mix_slot") / piece_slots))
    per_piece = placed.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    return _positions(placed, per_piece, out_names, block_rows, horizon)


def _exact_slots(spark, wanted, blocks):
    """((ts, tj, slot) of every block, the slot of the first exhaustion) for the weights as they are."""
    whole = integer_weights(wanted)
    names = sorted(blocks)
    weights, count = [whole[s] for s in names], [blocks[s] for s in names]
    size = max(SEGMENT, 4 * len(names))  # states stay smaller than the table they stand for
    states, horizon = _segments(weights, count, size)
    segments = spark.createDataFrame(states, "slot long, done array<long>, clock string, ended long")
    tasks = min(len(states), partitions(spark))
    slots = (segments.repartition(tasks).mapInArrow(_walked(names, weights, count, size), "ts string, j long, slot long"))
    return slots.withColumnRenamed("j", "tj"), horizon


def _cycle_slots(spark, wanted, blocks, cycle):
    """The same for weights rounded to a cycle: block j of a source with m slots a cycle stands in round j // m."""
    share = cycle_shares(wanted, cycle)
    line = edf_cycle(share)
    at = {s: [] for s in share}
    for slot, s in enumerate(line):
        at[s].append(slot)
    horizon = min(cycle * (b // share[s]) + at[s][b % share[s]] for s, b in blocks.items())
    rows = [(s, blocks[s], share[s], at[s]) for s in share]
    table = spark.createDataFrame(rows, "ts string, b long, m long, own array<long>")
    slots = table.withColumn("tj", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1)))
    slot = F.floor(F.col("tj") / F.col("m")) * cycle + F.element_at("own", (F.col("tj") % F.col("m") + 1).cast("int"))
    return slots.select("ts", "tj", slot.alias("slot")), horizon


def _positions(placed, per_piece, out_names, block_rows, horizon):
    group = F.floor(F.col("piece") / 1000)
    inside = F.sum("n").over(Window.partitionBy("g").orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    pieces = per_piece.withColumn("g", group).withColumn("inside", inside)
    groups = pieces.groupBy("g").agg(F.sum("n").alias("n"))
    # one row per 1000 pieces
    lead = groups.select(F.col("g").alias("lg"), (F.sum("n").over(
        Window.orderBy("g").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("lead"))
    offsets = (pieces.join(lead, F.col("g") == F.col("lg")).select(F.col("piece").alias("pp"), (F.col("inside") + F.col("lead")).alias("start")))
    rank = F.row_number().over(Window.partitionBy("piece").orderBy("mix_slot", "at")) - 1
    return (placed.withColumn("k", rank).join(offsets, F.col("piece") == F.col("pp"))
            .select(*out_names, (F.col("start") + F.col("k")).cast("long").alias("mix_position"), F.col("mix_slot").cast("long"),
                    F.col("mix_block").cast("long"), (F.col("mix_slot") < horizon).alias("in_mix")))
