"""URL filter lists with a history: every capture is judged by the entries that were active when it was fetched.

Dated additions and removals of an entry become validity intervals. An entry names a host and covers its subdomains.
Intervals are joined to the distinct hosts first, which are far fewer than captures, and each host carries its
intervals to its captures in one join; the as-of test runs on the row. No capture is multiplied by its host's
parents. The intervals of a host with many captures go to where these are, and captures without a host join nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.llm.texts import materialize, table
from kindred.operators.pairs import attach

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:]+)"
EPOCH = "2024-01-01 00:00:00"


def host_of(url: Column) -> Column:
    """The URL's host in lower case, without the root's dot, an IPv6 address in its brackets; null if there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", ""), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and the domains above it, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def validity(events: DataFrame) -> DataFrame:
    """(entry, category, valid_from, valid_to) of dated events (entry, category, at, action add or remove).

    An addition holds until the next removal, for ever if there is none (valid_to null); repeated additions extend
    it and repeated removals change nothing. Of events at one time the addition wins. Rows with a null entry, time or
    action are left out; a null category is one of its own.
    """
    usable = events.where(F.col("entry").isNotNull() & F.col("at").isNotNull() & F.col("action").isin("add", "remove"))
    states = usable.groupBy(F.lower("entry").alias("entry"), "category", "at").agg(F.max((F.col("action") == "add")).alias("active"))
    history = Window.partitionBy("entry", "category").orderBy("at")
    changes = states.withColumn("before", F.coalesce(F.lag("active").over(history), F.lit(False))).where("active != before")
    return (
        changes.withColumn("valid_to", F.lead("at").over(history)).where("active").select("entry", "category", F.col("at").alias("valid_from"), "valid_to")
    )


def judge(captures: DataFrame, intervals: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """Adds host, n_active, blocked, entry, category and listed_at to every capture.

    ``n_active`` counts the entries for the host or a domain above it that were active at the fetch: from valid_from on
    and before valid_to. The longest entry is reported, of equals the one with the first category (null last). A
    capture without a host or fetch time is not blocked. Rows may repeat and keep their other columns, unless named like
    those added.
    """
    added = ["host", "n_active", "blocked", "entry", "category", "listed_at"]
    kept = [c for c in captures.columns if c not in added]
    whole = F.struct(*[F.col(f"`{c}`") for c in kept], F.lit(0).alias("nothing else"))
    placed = captures.select(whole.alias("capture"), host_of(F.col(url)).alias("host"), F.col(fetched).alias("fetched"))
    hosts = materialize(placed.where("host is not null").groupBy("host").agg(F.count("*").alias("captures")), "hosts")
    total = hosts.agg(F.sum("captures")).first()[0] or 0
    known = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("entry"))
    lists = (
        known.join(intervals, "entry")
        .groupBy("host")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        (-F.length("entry")).alias("rank"), F.col("category").isNull().alias("unknown"), "category", "entry", "valid_from", "valid_to"
                    )
                )
            ).alias("intervals")
        )
    )
    at = F.col("fetched")
    active = F.filter("intervals", lambda x: (x["valid_from"] <= at) & (x["valid_to"].isNull() | (at < x["valid_to"])))
    lists = materialize(hosts.join(lists, "host", "left"), "host-lists")
    tested = attach(placed.where("host is not null"), lists, "host", "captures", total).withColumn("active", F.coalesce(active, F.array()))
    tested = tested.drop("captures", "intervals")
    nothing = F.lit(None).cast(dict(tested.dtypes)["active"])
    tested = tested.unionByName(placed.where("host is null").withColumn("active", F.coalesce(nothing, F.array())))
    best = F.get("active", F.lit(0))
    return tested.select(
        *[F.col("capture")[c].alias(c) for c in kept], "host", F.size("active").cast("long").alias("n_active"), (F.size("active") > 0).alias("blocked"),
        best["entry"].alias("entry"), best["category"].alias("category"), best["valid_from"].alias("listed_at"),
    )


def derived_events(pages: DataFrame) -> DataFrame:
    """A list history made from the pages' own hosts: about two thirds of all domains are listed at some time, half of these twice."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    entries = hosts.select(F.explode(suffixes(F.col("host"))).alias("entry")).where("entry like '%.%'").distinct()
    a, b, c = (F.conv(F.substring(F.md5("entry"), k, 4), 16, 10).cast("long") for k in (1, 5, 9))
    first = b % 8760
    gone = first + 24 * (10 + c % 120)
    again = gone + 24 * (5 + a % 60)
    dated = entries.where(a % 3 > 0).select(
        "entry",
        F.element_at(F.array(F.lit("spam"), F.lit("malware"), F.lit("adult")), (1 + c % 3).cast("int")).alias("category"),
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(first.alias("hour"), F.lit("add").alias("action")), F.struct(gone.alias("hour"), F.lit("remove").alias("action")),
                    F.when(a % 3 == 2, F.struct(again.alias("hour"), F.lit("add").alias("action"))),
                )
            )
        ).alias("event"),
    )
    return dated.select("entry", "category", after(F.col("event.hour")).alias("at"), F.col("event.action").alias("action"))


def after(hours: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH)) + hours * 3600)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged at its fetch time, which its id decides, by lists with a history."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", after(F.pmod(F.col("page_id") * 7919, F.lit(8760))))
    judged = judge(captures, validity(derived_events(pages)))
    return judged.select(
        "page_id", "host", "n_active", "blocked", "entry", "category", F.floor((F.unix_timestamp("listed_at") - F.unix_timestamp(F.lit(EPOCH))) / 3600).cast("long").alias("listed_hour")
    )


ORACLE = r"""
WITH captures AS (
  SELECT page_id, nullif(regexp_replace(lower(regexp_extract(
           url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:]+)', 1)), '\.$', ''), '') AS host,
         (page_id * 7919) % 8760 AS fetched
  FROM pages
), split_hosts AS (
  SELECT DISTINCT host, string_split(host, '.') AS labels FROM captures WHERE host IS NOT NULL
), entries AS (
  SELECT DISTINCT array_to_string(labels[i:], '.') AS entry
  FROM (SELECT labels, unnest(generate_series(1, len(labels) - 1)) AS i FROM split_hosts)
), digits AS (
  SELECT entry, CAST('0x' || substr(md5(entry), 1, 4) AS BIGINT) AS a, CAST('0x' || substr(md5(entry), 5, 4) AS BIGINT) AS b,
         CAST('0x' || substr(md5(entry), 9, 4) AS BIGINT) AS c
  FROM entries
), hours AS (
  SELECT entry, a, ['spam', 'malware', 'adult'][1 + c % 3] AS category, b % 8760 AS added,
         b % 8760 + 24 * (10 + c % 120) AS gone, b % 8760 + 24 * (10 + c % 120) + 24 * (5 + a % 60) AS again
  FROM digits WHERE a % 3 > 0
), intervals AS (
  SELECT entry, category, added AS valid_from, gone AS valid_to FROM hours
  UNION ALL SELECT entry, category, again, NULL FROM hours WHERE a % 3 = 2
), active AS (
  SELECT page_id, entry, category, valid_from,
         row_number() OVER (PARTITION BY page_id ORDER BY length(entry) DESC) AS place, count(*) OVER (PARTITION BY page_id) AS n
  FROM captures JOIN intervals
    ON (host = entry OR ends_with(host, '.' || entry)) AND valid_from <= fetched AND (valid_to IS NULL OR fetched < valid_to)
)
SELECT c.page_id, c.host, coalesce(n, 0) AS n_active, n IS NOT NULL AS blocked, entry, category, valid_from AS listed_hour
FROM captures c LEFT JOIN active a ON c.page_id = a.page_id AND place = 1
"""
