"""URL filters: a temporal join of captures with dated list entries.

A list entry says that from a day on a pattern (a host, a domain above it, or a
host with its first path segment) is blocked, allowed or no longer listed.
Entries of one pattern become validity intervals (each lasts until the next
one; of several on one day the strictest holds: block, allow, delist).  A
capture asks every pattern its URL falls under; the interval that holds at
fetch time answers (as-of join), the most specific active pattern decides.

The join is on pattern plus a salt: entries are repeated for each salt (a
fixed factor), captures of a hot host are dealt over all salts, so no key
holds more than its share of a hot host.  Entries are aggregated to intervals
before; nothing is broadcast without Spark's own size check.

A trailing dot of a host is dropped; an IPv4 or bracketed IPv6 address is one
label, with no domain above it.  The number of salts follows the number of
shuffle partitions.

A null or malformed URL matches nothing and is kept with action "none"; a null
day is before every entry.  Repeated rows give repeated results.  Entries with
a null pattern or day are void.  Empty tables give empty results or "none".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions

SALTS = 16
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]+)"
ADDRESS = r"^(\[.*|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^/?#]+)"
FIRST_DAY, DAYS = "2024-01-01", 730


def host(url: Column) -> Column:
    """Lower-cased host without trailing dots; "" where there is none."""
    return F.lower(F.rtrim(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1), F.lit(".")))


def patterns(url: Column) -> Column:
    """(specificity, pattern) of everything a URL falls under, from the whole host
    up to its last two labels, and the host with the first path segment."""
    h = host(url)
    # an address has no domains above it
    labels = F.when(h.rlike(ADDRESS), F.array(h)).otherwise(F.split(h, r"\."))
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.struct(
        (n - i).alias("specificity"), F.array_join(F.slice(labels, i + 1, n), ".").alias("pattern")))
    path = F.regexp_extract(F.coalesce(url, F.lit("")), SEGMENT, 1)
    first = F.when(path != "", F.array(F.struct((n + 1).alias("specificity"), F.concat(h, path).alias("pattern"))))
    return F.when(h == "", F.array().cast("array<struct<specificity:int,pattern:string>>")).otherwise(
        F.concat(domains, F.coalesce(first, F.array().cast("array<struct<specificity:int,pattern:string>>"))))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, since, until) from dated (pattern, day, action) rows; until is exclusive, null: still valid."""
    rank = F.when(F.col("action") == "block", 0).when(F.col("action") == "allow", 1).otherwise(2)
    daily = (entries.where("pattern is not null and day is not null").groupBy("pattern", "day")
             .agg(F.min_by("action", rank).alias("action")))
    until = F.lead("day").over(Window.partitionBy("pattern").orderBy("day"))
    return daily.select("pattern", "action", F.col("day").alias("since"), until.alias("until")).where("action <> 'delist'")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (page_id, url, day) with host, action, pattern, since, until."""
    salts = max(SALTS, min(256, partitions(captures.sparkSession) // 4))
    # deterministic row key: rows equal in all three columns answer alike and are counted
    rows = captures.groupBy("page_id", "url", "day").agg(F.count(F.lit(1)).alias("copies"))
    asked = rows.select("*", F.explode_outer(patterns(F.col("url"))).alias("p")).select(
        "page_id", "url", "day", "copies", "p.specificity", "p.pattern",
        F.pmod(F.xxhash64("page_id", "url", "day"), F.lit(salts)).alias("salt"))
    listed = (intervals(entries).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
              .select(F.col("pattern").alias("lp"), F.col("salt").alias("ls"), "action", "since", "until"))
    held = asked.join(listed, (F.col("pattern") == F.col("lp")) & (F.col("salt") == F.col("ls"))
                      & (F.col("since") <= F.col("day")) & (F.col("until").isNull() | (F.col("day") < F.col("until"))), "left")
    best = F.max(F.when(F.col("action").isNotNull(), F.struct("specificity", "pattern", "action", "since", "until")))
    out = held.groupBy("page_id", "url", "day", "copies").agg(best.alias("b"))
    out = out.select("page_id", "url", "day", F.nullif(host(F.col("url")), F.lit("")).alias("host"),
                     F.coalesce("b.action", F.lit("none")).alias("action"), F.col("b.pattern").alias("pattern"),
                     F.col("b.since").alias("listed_since"), F.col("b.until").alias("listed_until"),
                     F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return out.drop("copy")


# ---------------------------------------------------------------- data derived from ``pages``

def captures(pages: DataFrame) -> DataFrame:
    """Fetch days spread over two years by page id."""
    return pages.select("page_id", "url", F.date_add(F.lit(FIRST_DAY).cast("date"), (F.coalesce("page_id", F.lit(0)) * 37 % DAYS).cast("int")).alias("day"))


def _digits(key: Column, at: int) -> Column:
    return F.conv(F.substring(F.md5(key), at, 4), 16, 10).cast("int")


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the table's own hosts: a third of all patterns is listed, with up to three changes."""
    every = pages.select(F.explode(patterns(F.col("url"))).alias("p")).select("p.pattern").distinct()
    every = every.where(_digits(F.col("pattern"), 1) % 3 == 0)
    change = F.explode(F.sequence(F.lit(0), _digits(F.col("pattern"), 5) % 3)).alias("change")
    rows = every.select("pattern", change).withColumn("key", F.concat("pattern", F.lit("#"), F.col("change").cast("string")))
    action = F.element_at(F.array(F.lit("block"), F.lit("allow"), F.lit("delist")), _digits(F.col("key"), 1) % 3 + 1)
    return rows.select("pattern", F.date_add(F.lit(FIRST_DAY).cast("date"), _digits(F.col("key"), 5) % DAYS).alias("day"), action.alias("action"))


def filtered_captures(pages: DataFrame) -> DataFrame:
    out = evaluate(captures(pages), list_entries(pages))
    return out.select("page_id", "url", "host", *[F.col(c).cast("string").alias(c) for c in ("day",)], "action", "pattern",
                      F.col("listed_since").cast("string").alias("listed_since"), F.col("listed_until").cast("string").alias("listed_until"))


def oracle() -> str:
    return f"""
WITH c AS (SELECT page_id, url, DATE '{FIRST_DAY}' + (coalesce(page_id, 0) * 37 % {DAYS})::INT AS day,
    lower(rtrim(regexp_extract(coalesce(url, ''), '{HOST}', 1), '.')) AS host,
    regexp_extract(coalesce(url, ''), '{SEGMENT}', 1) AS path, row_number() OVER () AS r FROM pages),
l AS (SELECT *, CASE WHEN regexp_matches(host, '{ADDRESS}') THEN [host] ELSE string_split(host, '.') END AS labels FROM c WHERE host <> ''),
p AS (SELECT r, page_id, day, len(labels) - i AS specificity, array_to_string(labels[i + 1:], '.') AS pattern
      FROM (SELECT *, unnest(range(0, greatest(len(labels) - 2, 0) + 1)) AS i FROM l)
      UNION ALL SELECT r, page_id, day, len(labels) + 1, host || path FROM l WHERE path <> ''),
k AS (SELECT pattern, unnest(range(0, ('0x' || md5(pattern)[5:8])::INT % 3 + 1)) AS change
      FROM (SELECT DISTINCT pattern FROM p) WHERE ('0x' || md5(pattern)[1:4])::INT % 3 = 0),
e AS (SELECT pattern, DATE '{FIRST_DAY}' + ('0x' || md5(pattern || '#' || change)[5:8])::INT % {DAYS} AS day,
      ('0x' || md5(pattern || '#' || change)[1:4])::INT % 3 AS act FROM k),
d AS (SELECT pattern, day, min(act) AS act FROM e GROUP BY pattern, day),
v AS (SELECT pattern, act, day AS since, lead(day) OVER (PARTITION BY pattern ORDER BY day) AS until FROM d),
m AS (SELECT p.r, p.specificity, p.pattern, v.act, v.since, v.until,
        row_number() OVER (PARTITION BY p.r ORDER BY p.specificity DESC, p.pattern DESC) AS n
      FROM p JOIN v ON p.pattern = v.pattern AND v.since <= p.day AND (v.until IS NULL OR p.day < v.until) WHERE v.act < 2)
SELECT c.page_id, c.url, nullif(c.host, '') AS host, CAST(c.day AS VARCHAR) AS day,
  CASE m.act WHEN 0 THEN 'block' WHEN 1 THEN 'allow' ELSE 'none' END AS action, m.pattern,
  CAST(m.since AS VARCHAR) AS listed_since, CAST(m.until AS VARCHAR) AS listed_until
FROM c LEFT JOIN m ON c.r = m.r AND m.n = 1"""
