"""Survey scores: category sums (A5-A7), question matrices.

Which counties each block yields (kept as in the reference):

* category sums: counties in scope with at least one response in a chosen
  category; zero-filled inside the block;
* question matrix: every county in scope (dense), zero where no response.

The dense matrix is built without the counties x questions product: the
responses of the chosen questions are pivoted by county and left-joined to
the spine, then zero-filled. The long dense form unpivots that result.
Values are summed as doubles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionpanel.functions.keys import in_list, name_key, quote, select_sql, sql_lit, sum_sql, zero_fill_sql

from regionpanel.operators.dimension import by_county, county_dimension, scoped_facts, sized_spine
from regionpanel.operators import wide as wide_ops
from regionpanel.operators.wide import pivot_by_key
from regionpanel.plans.spec import Scope
from regionpanel.sources.schema import META
from regionpanel.sources.tables import Tables

SUFFIX = "_Sum"


# ----------------------------------------------------------------- lookups (L4)

def question_ids(tables: Tables, requested) -> list[int]:
    """Question names (case/space-insensitive, any category) or ids -> ids,
    ordered by id. Only the matching dictionary rows reach the driver."""
    names, ids = [], []
    for item in requested or ():
        if isinstance(item, int):
            ids.append(item)
        elif str(item).strip():
            names.append(str(item).strip().lower())
    if not names and not ids:
        return []
    names, ids = tuple(sorted(set(names))), tuple(sorted(set(ids)))

    def lookup():
        cond = F.lit(False)
        if names:
            cond = cond | name_key("question").isin(list(names))
        if ids:
            cond = cond | in_list("question_id", ids)
        rows = tables.questions.where(cond).select("question_id", "question").collect()
        return {r.question_id: r.question for r in rows}

    found = tables.memo(("questions", names, ids), lookup)
    for q, text in found.items():
        tables.memo(("question_text", q), lambda text=text: text)
    return sorted(found)


def question_labels(tables: Tables, qids: list[int]) -> dict[int, str]:
    """id -> column label (the question text) in the given id order.

    Deviation: two ids with one text get distinct columns, later ones
    suffixed `` (#id)`` (the reference raises)."""
    if not qids:
        return {}
    missing = [q for q in qids if ("question_text", q) not in tables._memo]
    if missing:
        rows = tables.questions.where(in_list("question_id", missing)).select("question_id", "question").collect()
        for r in rows:
            tables.memo(("question_text", r.question_id), lambda r=r: r.question)
    text = {q: tables._memo[("question_text", q)] for q in qids if ("question_text", q) in tables._memo}
    seen, labels = set(), {}
    for q in qids:
        if q not in text:
            continue
        lbl = text[q]
        if lbl in seen:
            lbl = f"{lbl} (#{q})"
        seen.add(lbl)
        labels[q] = lbl
    return labels


# ------------------------------------------------------------ category sums

def with_category(tables: Tables, responses: DataFrame, keep) -> DataFrame:
    """Responses with their question's category, restricted by ``keep``
    (a predicate over ``category`` / ``question_id``). A snapshot stores the
    category on each response (filter pushed into the scan, no join);
    otherwise the question dictionary is joined (inner: unknown questions
    drop out, as in the reference)."""
    if "category" in responses.columns:
        return responses.where(keep)
    q = tables.questions.select("question_id", "category")
    return responses.join(q, "question_id", "inner").where(keep)


def category_responses(tables: Tables, scope: Scope, categories: list[str]) -> DataFrame:
    """(county_key, category, value) of responses to questions of the categories."""
    r = scoped_facts(tables.responses, tables, scope)
    return with_category(tables, r, in_list("category", categories)).select("county_key", "category", "value")


def score_long(tables: Tables, scope: Scope, categories: list[str]) -> DataFrame:
    """SUM(value) per county x category, inner joins (no zero rows)."""
    spine = sized_spine(tables, scope)
    agg = (category_responses(tables, scope, categories)
           .groupBy("county_key", "category").agg(F.sum("value").alias("score")))
    return (spine.join(agg, "county_key", "inner")
            .select(*META, "category", F.col("score").cast("double").alias("county_category_score")))


def question_sums(tables: Tables, scope: Scope, category: str) -> DataFrame:
    """County x question sums of every question of a category that has
    responses, long: the number of questions is data, not request."""
    r = scoped_facts(tables.responses, tables, scope).drop("category")
    cells = r.groupBy("county_key", "question_id").agg(F.sum("value").alias("value_sum"))
    asked = tables.questions.where(F.col("category") == category).select("question_id", F.col("question").alias("question_name"))
    return (sized_spine(tables, scope).join(cells.join(asked, "question_id"), "county_key", "inner")
            .select(*META, "question_id", "question_name", "value_sum"))


def score_block(tables: Tables, scope: Scope, categories: list[str], suffix: str = SUFFIX) -> DataFrame:
    """county_key + ``<category><suffix>`` columns, zero-filled (A7 core)."""
    labels = {c: c + suffix for c in categories}
    wide = by_county(tables, "responses", scope, lambda r: pivot_by_key(
        with_category(tables, r, in_list("category", categories)).select("county_key", "category", "value"), "category", "value", labels, "sum"))
    return select_sql(wide, ["county_key", *[zero_fill_sql(quote(lbl), lbl) for lbl in labels.values()]])


def score_wide(tables: Tables, scope: Scope, categories: list[str], suffix: str = SUFFIX) -> DataFrame:
    """One row per county with a response in a chosen category; a
    category never seen is a 0.0 column; requested order."""
    spine = sized_spine(tables, scope)
    block = score_block(tables, scope, categories, suffix)
    return select_sql(spine.join(block, "county_key", "inner"), [*META, *[quote(c + suffix) for c in categories]])


# ----------------------------------------------------------- question matrix

def question_cells(tables: Tables, scope: Scope, labels: dict[int, str], total: str | None = None) -> DataFrame:
    """county_key + one sum per chosen question (NULL = no response),
    plus the sum over all of them when ``total`` is given."""
    return by_county(tables, "responses", scope, lambda r: pivot_by_key(
        r.where(in_list("question_id", labels)).select("county_key", "question_id", "value"), "question_id", "value", labels, "sum",
        total=total))


def question_matrix(tables: Tables, scope: Scope, labels: dict[int, str],
                    total_col: str = "selected_total") -> DataFrame:
    """A10 + A11: every county in scope, one column per question (0.0 if no
    response), plus the row total (summed in the aggregate, exact).

    Few questions: one conditional aggregate by county, joined to the spine.
    Many questions: the (county, question) sums — narrow rows, as many as
    non-empty cells — are joined to the spine first and pivoted after, so
    no wide row is ever shuffled or sorted; the pivot's grouping is already
    satisfied by the join's partitioning on county_key."""
    spine = county_dimension(tables, scope)
    cols = list(labels.values())
    if not labels:  # nothing asked: a typed empty frame
        return spine.select(*META, F.lit(0.0).alias(total_col)).where(F.lit(False))
    if len(labels) <= wide_ops.CONDITIONAL_LIMIT:
        cells = question_cells(tables, scope, labels, total="_total")
        joined = spine.join(cells, "county_key", "left")
        return select_sql(joined, [*META, *[zero_fill_sql(quote(c), c) for c in cols],
                                   zero_fill_sql("`_total`", total_col)])
    r = scoped_facts(tables.responses, tables, scope).where(in_list("question_id", labels))
    cells = r.groupBy("county_key", "question_id").agg(F.sum("value").alias("_v"))
    # the join needs both sides hashed on county_key anyway; numbering the
    # partitions keeps AQE from coalescing them by input size: the input is
    # narrow, the pivot's output is not
    n = int(tables.states.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows of the spine stay apart even if two are alike, as on the other side of the limit
    spine = spine.withColumn("_row", F.monotonically_increasing_id())
    joined = spine.repartition(n, "county_key").join(cells.repartition(n, "county_key"), "county_key", "left")
    wide = joined.groupBy("county_key", "_row", *META).pivot("question_id", list(labels)).agg(F.first("_v"))
    slots = [quote(str(q)) for q in labels]
    return select_sql(wide, [*META, *[zero_fill_sql(s, c) for s, c in zip(slots, cols)],
                             zero_fill_sql(sum_sql(slots), total_col)])


def question_long_dense(tables: Tables, scope: Scope, labels: dict[int, str]) -> DataFrame:
    """County x question rows for every county in scope, 0.0 if no
    response — the unpivot of the dense matrix (no cross join)."""
    wide = question_matrix(tables, scope, labels)
    if not labels:
        return wide.select(*META, F.lit(0).cast("long").alias("question_id"), F.lit("").alias("question_name"),
                           F.lit(0.0).alias("value_sum"))
    rows = ", ".join(f"named_struct('question_id', CAST({q} AS BIGINT), 'question_name', {sql_lit(lbl)}, "
                     f"'value_sum', {quote(lbl)})" for q, lbl in labels.items())
    return select_sql(wide, [*META, f"inline(array({rows}))"])


# ------------------------------------------------------------- assembler

@dataclass
class Block:
    """County-level block: ``frame`` has county_key + ``columns``; ``dense``
    blocks cover every county of the scope."""

    frame: DataFrame
    columns: list[str]
    dense: bool = False
    marker: str | None = None          # boolean column: row belongs to the block
    zero_cols: tuple[str, ...] = ()    # filled with 0.0 after the merge (dense parts)
    # wide detail selections: (county_key, question_id, _v) cells, pivoted by
    # the assembler after every narrow join; cell_labels maps id -> column
    cells: DataFrame | None = None
    cell_labels: dict | None = None


def response_blocks(tables: Tables, scope: Scope, spec_categories, suffix: str = SUFFIX):
    """All score columns of a request from ONE aggregate over responses.

    Sum-mode categories and detail-mode questions share a single
    ``groupBy(county_key)`` of conditional sums (one scan, one exchange);
    a flag records whether the county had a response in a sum category, so
    the sum block keeps its own row set after the merge.
    Returns (aggregate, sum categories, detail specs, long detail cells or
    None) or None when nothing is asked.
    """
    sum_cats, details, seen = [], [], set()
    for choice in spec_categories:
        if choice.category in seen:
            continue
        seen.add(choice.category)
        if choice.sum_scores:
            sum_cats.append(choice.category)
        else:
            qids = question_ids(tables, choice.selected_questions)
            labels = question_labels(tables, qids)
            if labels:  # a detail category without questions adds nothing
                details.append((choice.category, labels))
    if not sum_cats and not details:
        return None

    all_qids = sorted({q for _, labels in details for q in labels})

    def asked(r: DataFrame) -> DataFrame:
        """Responses that some block needs, with their category where a sum needs it."""
        if sum_cats:
            keep = in_list("category", sum_cats) | in_list("question_id", all_qids)
            return with_category(tables, r, keep).select("county_key", "question_id", "category", "value")
        return (r.where(in_list("question_id", all_qids)).select("county_key", "question_id", "value")
                .withColumn("category", F.lit(None).cast("string")))

    cat, qid = F.col("category"), F.col("question_id")
    wide_request = len(all_qids) > wide_ops.CONDITIONAL_LIMIT
    if wide_request:
        r = asked(scoped_facts(tables.responses, tables, scope))
        # O(1) per response row: sums per (county, asked question) first, all
        # other questions of a summed category as one cell per category; both
        # aggregates below read these cells (one exchange, reused)
        r = r.withColumn("question_id", F.when(in_list("question_id", all_qids), qid))
        r = r.groupBy("county_key", "question_id", "category").agg(F.sum("value").alias("value"))
        # both aggregates below group by county: one numbered exchange serves
        # both, and AQE does not squeeze the wide pivot into a single task
        n = int(tables.states.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        r = r.repartition(n, "county_key")
    val = F.col("value")
    aggs = []
    if sum_cats:
        aggs.append(F.max(in_list("category", sum_cats)).alias("_in_sums"))
        aggs += [F.sum(F.when(cat == F.lit(c), val)).alias(f"_s{i}") for i, c in enumerate(sum_cats)]
    aggs += [F.sum(F.when(in_list("question_id", labels), val)).alias(f"_t{j}") for j, (_, labels) in enumerate(details)]
    if wide_request:
        # narrow aggregates here; the detail cells stay long and are pivoted
        # by the assembler after the narrow joins (no wide row is sorted)
        agg = r.groupBy("county_key").agg(*aggs)
        cells = (r.where(in_list("question_id", all_qids))
                 .select("county_key", "question_id", F.col("value").alias("_v")))
        return agg, sum_cats, details, cells
    aggs += [F.sum(F.when(qid == F.lit(q), val)).alias(f"_q{q}") for q in all_qids]
    agg = by_county(tables, "responses", scope, lambda r: asked(r).groupBy("county_key").agg(*aggs))
    return agg, sum_cats, details, None


def score_blocks(tables: Tables, scope: Scope, spec_categories, suffix: str = SUFFIX) -> DataFrame:
    """A12 on its own: details (spec order) then sums, merged on the spine."""
    from regionpanel.operators.assemble import assemble_counties

    blocks = score_block_list(tables, scope, spec_categories, suffix)
    return assemble_counties(tables, scope, blocks)


def score_block_list(tables: Tables, scope: Scope, spec_categories, suffix: str = SUFFIX) -> list[Block]:
    got = response_blocks(tables, scope, spec_categories, suffix)
    if got is None:
        return []
    agg, sum_cats, details, cells = got
    out_cols, cols, zero_cols, cell_labels = [], [], [], {}
    for j, (category, labels) in enumerate(details):
        for q, lbl in labels.items():
            if lbl in out_cols:        # same question in two detail blocks: first wins (J9)
                continue
            if cells is None:
                cols.append(zero_fill_sql(f"`_q{q}`", lbl))
            else:
                cell_labels[q] = lbl
            out_cols.append(lbl)
        cols.append(zero_fill_sql(f"`_t{j}`", category + suffix))
        out_cols.append(category + suffix)
    zero_cols = list(out_cols)
    marker = None
    if sum_cats:
        marker = "_in_sums"
        for i, c in enumerate(sum_cats):
            cols.append(f"CASE WHEN `_in_sums` THEN coalesce(CAST(`_s{i}` AS DOUBLE), 0.0) END AS {quote(c + suffix)}")
            out_cols.append(c + suffix)
    frame = select_sql(agg, ["county_key", *(["`_in_sums`"] if sum_cats else []), *cols])
    return [Block(frame, out_cols, dense=bool(details), marker=marker, zero_cols=tuple(zero_cols),
                  cells=cells, cell_labels=cell_labels or None)]
