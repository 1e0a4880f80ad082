"""URL filters (method: temporal list join).

A filter list is a table of dated entries ``key, action, day``: from that day on
the key is blocked, allowed, or (``remove``) no longer listed.  Entries become
validity intervals ``[day, next entry's day)``; each capture looks up its keys
(host with parent domains, host with first path segment) among the intervals
that hold on its fetch day.  The longest key that is listed then decides.

Only the URL column is read.  Captures join the intervals by key, an equi-join
with the interval as further condition: hot hosts are split by adaptive
execution, and a small list is broadcast only where Spark's statistics prove it
small.

Defined results: a null or unparsable URL has no host and is kept; a null fetch
day matches nothing; of entries of one key and day the greatest action counts;
a verdict belongs to a URL and day, so repeated captures get equal rows and two
captures of one page (or of none) may differ; entries with a null key or day are
void; further columns of either table take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-case host without port, user and leading ``www.``; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(host, r"^.*@|:\d*$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", host)


def keys_of(url: Column) -> Column:
    """Keys under which a list may hold a URL."""
    labels = F.split(host_of(url), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segment = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)
    path = F.when(segment != "", F.array(F.concat(host_of(url), F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(suffixes, path))


def intervals(entries: DataFrame) -> DataFrame:
    """``key, action, since, until`` (exclusive, null: open) from dated entries."""
    daily = entries.where("key is not null and day is not null").groupBy("key", "day").agg(F.max("action").alias("action"))
    until = F.lead("day").over(Window.partitionBy("key").orderBy("day"))
    return daily.select("key", "action", F.col("day").alias("since"), until.alias("until")).where("action <> 'remove'")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``page_id, fetch_day, host, matched_key, action, since, kept`` of each capture (``page_id, url, fetch_day``)."""
    rows = captures.select("page_id", "url", "fetch_day", host_of(F.col("url")).alias("host"))
    asked = rows.where("host is not null and fetch_day is not null").select("url", "fetch_day").distinct().withColumn("key", F.explode(keys_of(F.col("url"))))
    listed = intervals(entries)
    active = asked.join(listed, (asked["key"] == listed["key"]) & (F.col("since") <= F.col("fetch_day")) & (F.col("until").isNull() | (F.col("fetch_day") < F.col("until"))))
    best = F.max(F.struct(F.length(asked["key"]).alias("n"), asked["key"].alias("k"), F.col("action").alias("a"), F.col("since").alias("s"))).alias("_best")
    hit = active.groupBy("url", "fetch_day").agg(best).select(F.col("url").alias("_url"), F.col("fetch_day").alias("_day"), "_best")
    out = rows.join(hit, (rows["url"] == F.col("_url")) & (rows["fetch_day"] == F.col("_day")), "left")
    return out.select(
        "page_id", "fetch_day", "host", F.col("_best.k").alias("matched_key"), F.col("_best.a").alias("action"), F.col("_best.s").alias("since"),
        F.coalesce(F.col("_best.a") != "block", F.lit(True)).alias("kept"),
    )


# The test tables have neither fetch days nor lists; both follow from the pages by the rules below, which the SQL repeats.


def with_days(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("page_id") * 37) % 366).cast("int")).alias("fetch_day"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """Entries for hosts and for paths: by the digest of the key, some are blocked in spring, freed, and listed again."""
    keys = pages.select(F.explode(keys_of(F.col("url"))).alias("key")).where("key is not null").distinct()
    number = lambda at: F.conv(F.substring(F.md5("key"), at, 4), 16, 10).cast("int")
    first = F.date_add(F.lit("2024-01-01").cast("date"), number(5) % 120)
    second = F.date_add(first, 1 + number(9) % 90)
    third = F.date_add(second, 1 + number(13) % 90)
    entry = lambda action, day: F.struct(F.lit(action).alias("action"), day.alias("day"))
    kinds = F.when(number(1) % 5 == 0, F.array(entry("block", first), entry("remove", second), entry("block", third))).when(number(1) % 5 == 1, F.array(entry("block", first), entry("allow", second)))
    return keys.select("key", F.explode(kinds).alias("e")).select("key", "e.action", "e.day")


SQL = r"""
WITH rows AS (
  SELECT page_id, url, DATE '2024-01-01' + ((page_id * 37) % 366)::INT AS fetch_day,
    nullif(regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@|:\d*$', ''), '^www\.', ''), '') AS host,
    nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1), '') AS segment
  FROM pages),
asked AS (
  SELECT DISTINCT url, fetch_day, key FROM (
    SELECT url, fetch_day, array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') AS key
    FROM (SELECT *, unnest(range(1, greatest(len(string_split(host, '.')), 2))) AS i FROM rows WHERE host IS NOT NULL)
    UNION ALL SELECT url, fetch_day, host || '/' || segment FROM rows WHERE host IS NOT NULL AND segment IS NOT NULL)),
keys AS (
  SELECT key, ('0x' || substr(md5(key), 1, 4))::INT AS a, ('0x' || substr(md5(key), 5, 4))::INT % 120 AS d1,
    1 + ('0x' || substr(md5(key), 9, 4))::INT % 90 AS d2, 1 + ('0x' || substr(md5(key), 13, 4))::INT % 90 AS d3
  FROM (SELECT DISTINCT key FROM asked)),
entries AS (
  SELECT key, 'block' AS action, DATE '2024-01-01' + d1 AS day FROM keys WHERE a % 5 IN (0, 1)
  UNION ALL SELECT key, CASE a % 5 WHEN 0 THEN 'remove' ELSE 'allow' END, DATE '2024-01-01' + d1 + d2 FROM keys WHERE a % 5 IN (0, 1)
  UNION ALL SELECT key, 'block', DATE '2024-01-01' + d1 + d2 + d3 FROM keys WHERE a % 5 = 0),
listed AS (SELECT key, action, day AS since, lead(day) OVER (PARTITION BY key ORDER BY day) AS until FROM entries),
best AS (
  SELECT url, fetch_day, key, action, since, row_number() OVER (PARTITION BY url, fetch_day ORDER BY length(key) DESC, key DESC, action DESC, since DESC) AS rn
  FROM asked JOIN listed USING (key) WHERE action <> 'remove' AND since <= fetch_day AND (until IS NULL OR fetch_day < until))
SELECT rows.page_id, rows.fetch_day, host, best.key AS matched_key, action, since, coalesce(action <> 'block', true) AS kept
FROM rows LEFT JOIN best ON rows.url = best.url AND rows.fetch_day = best.fetch_day AND rn = 1
"""
