"""URL filtering against dated block and allow lists, by a temporal (as-of) join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_ascii, table


def url_host(url: Column) -> Column:
    """Lower-case host of a URL without user, port or a final dot; null where there is none."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?i:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(rest, r"^.*@", ""), r"(:[0-9]*)?$", "")
    host = F.regexp_replace(lower_ascii(host), r"\.+$", "")
    return F.when(host != "", host)


def url_segments(url: Column) -> Column:
    """The path segments of a URL in order, without empty ones; none where there is no path."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?i:[a-z][a-z0-9+.-]*:)?//[^/?#]*/([^?#]*)", 1)
    return F.array_remove(F.split(path, "/", -1), "")


def lookup_keys(url: Column) -> Column:
    """What list entries may name for a URL, most specific first: the host with each leading part of the path, the host, and all its parents down to one label."""
    host, segments = url_host(url), url_segments(url)
    labels, depth = F.size(F.split(host, r"\.")), F.size(segments)
    paths = F.when(depth > 0, F.transform(F.sequence(depth, F.lit(1)), lambda n: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), n), "/"))))
    parents = F.when(labels > 1, F.transform(F.sequence(labels - 1, F.lit(1)), lambda n: F.call_function("substring_index", host, F.lit("."), -n)))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(F.concat(F.coalesce(paths, none), F.array(host), F.coalesce(parents, none))))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """Dated entries (entry, action, at) as intervals (entry, action, valid_from, valid_to): an entry holds until the next one of the same name.

    action is 'block', 'allow' or 'remove'; 'remove' ends what was before and gives no interval. Entries of the same name and time:
    the greatest action in the order remove > block > allow holds. valid_to is null while an entry still holds. Null names or times are left out.
    """
    rank = F.when(F.col("action") == "remove", 2).when(F.col("action") == "block", 1).otherwise(0)
    one = entries.where(F.col("entry").isNotNull() & F.col("at").isNotNull() & F.col("action").isNotNull()).groupBy("entry", "at").agg(F.max_by("action", rank).alias("action"))
    later = Window.partitionBy("entry").orderBy("at")
    spans = one.select("entry", "action", F.col("at").alias("valid_from"), F.lead("at").over(later).alias("valid_to"))
    return spans.where(F.col("action") != "remove")


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Decides each capture (page_id, url, fetched_at) by the list entries active when it was fetched.

    The most specific active entry decides (host/path with the longest path, host, then longer parents first); without one the capture is
    allowed. One row for each distinct capture, n_rows saying how often it occurs. Captures without a host or a fetch time match nothing.
    Other columns of either table don't matter; empty tables give no rows, or captures that match nothing.
    The join is on the entry's name, so a host with a third of the captures is split by the adaptive skew join;
    the rows of one capture are gathered again by a partial aggregation on the capture itself.
    """
    spans = validity_intervals(entries)
    ids = ["page_id", "url", "fetched_at"]
    keyed = captures.groupBy(*ids).agg(F.count("*").alias("n_rows")).select(*ids, "n_rows", F.posexplode_outer(lookup_keys(F.col("url"))).alias("depth", "entry"))
    active = (F.col("k.entry") == F.col("s.entry")) & (F.col("k.fetched_at") >= F.col("s.valid_from")) & (F.col("s.valid_to").isNull() | (F.col("k.fetched_at") < F.col("s.valid_to")))
    joined = keyed.alias("k").join(spans.alias("s"), active, "left")
    hit = F.when(F.col("s.action").isNotNull(), F.struct(F.col("k.depth").alias("depth"), F.col("s.entry").alias("entry"), F.col("s.action").alias("action"), F.col("s.valid_from").alias("valid_from"), F.col("s.valid_to").alias("valid_to")))
    best = joined.groupBy(*(F.col(f"k.{c}") for c in ids)).agg(F.max("k.n_rows").alias("n_rows"), F.min(hit).alias("hit"))
    return best.select(*ids, "n_rows", url_host(F.col("url")).alias("host"), F.col("hit.entry").alias("entry"), F.col("hit.valid_from").alias("valid_from"), F.col("hit.valid_to").alias("valid_to"), F.coalesce(F.col("hit.action"), F.lit("none")).alias("action"), (F.coalesce(F.col("hit.action"), F.lit("none")) != "block").alias("allowed"))


def sample_captures(pages: DataFrame) -> DataFrame:
    """The pages as captures: as the table has no fetch times, page n was fetched 37 n mod 730 days after 2023-01-01."""
    day = F.pmod(F.col("page_id") * 37, F.lit(730)).cast("int")
    return pages.select("page_id", "url", F.date_add(F.lit("2023-01-01").cast("date"), day).alias("fetched_at"))


def sample_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the names in pages, by a fixed rule on c, the first 8 hexadecimal digits of a name's md5.

    Hosts with c mod 4 = 0 are blocked on day c mod 400, removed 120 days later and blocked again 200 days after that.
    host/segment names with c mod 6 = 1 are allowed from day c mod 500, names with two segments and c mod 5 = 2 blocked from day c mod 450.
    Two-label parents with c mod 3 = 2 are blocked from day 365, and parents of one label with c mod 2 = 1 allowed from day 30.
    """
    keys = pages.select(url_host(F.col("url")).alias("host"), F.slice(url_segments(F.col("url")), 1, 2).alias("segments")).where(F.col("host").isNotNull()).distinct()
    first = F.lit("2023-01-01").cast("date")

    def dated(names: DataFrame, chosen: Column, steps: list[tuple[str, Column]]) -> DataFrame:
        rows = names.distinct().withColumn("c", F.conv(F.substring(F.md5(F.col("entry").cast("binary")), 1, 8), 16, 10).cast("bigint")).where(chosen)
        return rows.select("entry", F.inline(F.array(*(F.struct(F.lit(a).alias("action"), F.date_add(first, d.cast("int")).alias("at")) for a, d in steps))))

    c = F.col("c")
    hosts = dated(keys.select(F.col("host").alias("entry")), c % 4 == 0, [("block", c % 400), ("remove", c % 400 + 120), ("block", c % 400 + 320)])
    path = lambda n: keys.where(F.size("segments") >= n).select(F.concat("host", F.lit("/"), F.array_join(F.slice("segments", 1, n), "/")).alias("entry"))
    paths = dated(path(1), c % 6 == 1, [("allow", c % 500)]).unionByName(dated(path(2), c % 5 == 2, [("block", c % 450)]))
    parents = dated(keys.select(F.substring_index("host", ".", -2).alias("entry")), c % 3 == 2, [("block", F.lit(365))])
    tops = dated(keys.select(F.substring_index("host", ".", -1).alias("entry")), c % 2 == 1, [("allow", F.lit(30))])
    return hosts.unionByName(paths).unionByName(parents).unionByName(tops)


def op10_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of `pages` against a dated list, decided as of its fetch time."""
    pages = table(spark, sf_dir, "pages")
    out = filter_captures(sample_captures(pages), sample_entries(pages))
    return out.withColumns({c: F.col(c).cast("string") for c in ("fetched_at", "valid_from", "valid_to")})


#: The same rule in SQL: every leading part of the path, the host and every parent of it, without a limit.
ORACLE_SQL = r"""
WITH parts AS (
  SELECT page_id, url, CAST(date '2023-01-01' + CAST((page_id * 37) % 730 AS INT) AS DATE) AS fetched_at,
    rtrim(translate(regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''), '^(?i:[a-z][a-z0-9+.-]*:)?//([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.') AS h,
    list_filter(string_split(regexp_extract(coalesce(url, ''), '^(?i:[a-z][a-z0-9+.-]*:)?//[^/?#]*/([^?#]*)', 1), '/'), lambda x: x <> '') AS segments
  FROM pages),
named AS (SELECT *, nullif(h, '') AS host, string_split(h, '.') AS labels FROM parts),
names AS (
  SELECT DISTINCT host AS entry, 'host' AS kind FROM named WHERE host IS NOT NULL
  UNION SELECT DISTINCT host || '/' || segments[1], 'path' FROM named WHERE host IS NOT NULL AND len(segments) >= 1
  UNION SELECT DISTINCT host || '/' || segments[1] || '/' || segments[2], 'deep' FROM named WHERE host IS NOT NULL AND len(segments) >= 2
  UNION SELECT DISTINCT array_to_string(labels[-2:], '.'), 'parent' FROM named WHERE host IS NOT NULL
  UNION SELECT DISTINCT labels[-1], 'top' FROM named WHERE host IS NOT NULL),
hashed AS (SELECT *, CAST('0x' || substr(md5(entry), 1, 8) AS BIGINT) AS c FROM names),
dated AS (
  SELECT entry, action, CAST(date '2023-01-01' + CAST(day AS INT) AS DATE) AS since FROM (
    SELECT entry, 'block' AS action, c % 400 AS day FROM hashed WHERE kind = 'host' AND c % 4 = 0
    UNION ALL SELECT entry, 'remove', c % 400 + 120 FROM hashed WHERE kind = 'host' AND c % 4 = 0
    UNION ALL SELECT entry, 'block', c % 400 + 320 FROM hashed WHERE kind = 'host' AND c % 4 = 0
    UNION ALL SELECT entry, 'allow', c % 500 FROM hashed WHERE kind = 'path' AND c % 6 = 1
    UNION ALL SELECT entry, 'block', c % 450 FROM hashed WHERE kind = 'deep' AND c % 5 = 2
    UNION ALL SELECT entry, 'block', 365 FROM hashed WHERE kind = 'parent' AND c % 3 = 2
    UNION ALL SELECT entry, 'allow', 30 FROM hashed WHERE kind = 'top' AND c % 2 = 1)),
one AS (SELECT entry, since, max_by(action, CASE action WHEN 'remove' THEN 2 WHEN 'block' THEN 1 ELSE 0 END) AS action FROM dated GROUP BY entry, since),
spans AS (SELECT * FROM (SELECT entry, action, since AS valid_from, lead(since) OVER (PARTITION BY entry ORDER BY since) AS valid_to FROM one) WHERE action <> 'remove'),
captures AS (SELECT page_id, url, fetched_at, host, segments, labels, count(*) AS n_rows FROM named GROUP BY ALL),
listed AS (
  SELECT page_id, url, fetched_at, list_concat(
    list_transform(range(len(segments), 0, -1), lambda n: host || '/' || array_to_string(segments[1:n], '/')), [host],
    list_transform(range(1, len(labels)), lambda n: array_to_string(labels[n + 1:], '.'))) AS entries
  FROM captures WHERE host IS NOT NULL),
keyed AS (SELECT page_id, url, fetched_at, unnest(range(len(entries))) AS depth, unnest(entries) AS entry FROM listed),
hits AS (
  SELECT k.page_id, k.url, k.fetched_at, arg_min(s.entry, k.depth) AS entry, arg_min(s.action, k.depth) AS action,
    arg_min(s.valid_from, k.depth) AS valid_from, min_by({'v': s.valid_to}, k.depth).v AS valid_to
  FROM keyed k JOIN spans s ON k.entry = s.entry AND k.fetched_at >= s.valid_from AND (s.valid_to IS NULL OR k.fetched_at < s.valid_to)
  GROUP BY ALL)
SELECT c.page_id, c.url, CAST(c.fetched_at AS VARCHAR) AS fetched_at, c.n_rows, c.host, h.entry, CAST(h.valid_from AS VARCHAR) AS valid_from, CAST(h.valid_to AS VARCHAR) AS valid_to,
  coalesce(h.action, 'none') AS action, coalesce(h.action, 'none') <> 'block' AS allowed
FROM captures c LEFT JOIN hits h ON c.page_id IS NOT DISTINCT FROM h.page_id AND c.url IS NOT DISTINCT FROM h.url AND c.fetched_at IS NOT DISTINCT FROM h.fetched_at
"""
