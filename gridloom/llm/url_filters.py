"""URL filters: a temporal list join in DataFrame operations alone.

Dated list events become validity intervals. For each host of the captures the intervals of the host and of its parent
domains are merged into one timeline of non-overlapping segments, so the as-of join finds at most one segment for a capture
and a hot host never multiplies its captures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The end of an interval that nothing closes.
FOREVER = "9999-12-31"
#: Parts that the captures of one host, and the hosts under one parent domain, are dealt into.
SALT, PARENT_SALT = 32, 8


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, without user, port, leading ``www.`` and trailing dot; NULL if there is none."""
    host = F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"\.$", ""), r"^www\.", "")
    return F.when(host != "", host)


def host_suffixes(host: Column) -> Column:
    """The host and its parent domains down to two labels (a single label stands for itself)."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    starts = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    return F.transform(starts, lambda i: F.array_join(F.slice(labels, i, n), "."))


def validity_intervals(events: DataFrame) -> DataFrame:
    """Intervals ``[valid_from, valid_to)`` in which a key stands on a list.

    ``events`` has list_name, key, action (``add`` or ``remove``) and at. The last event at or before a time decides; of
    events at one time ``remove`` wins. Rows with a null in any of the four columns are no events; other columns are ignored.
    """
    clean = events.select(
        F.col("list_name").cast("string"), F.lower(F.col("key")).alias("key"), F.lower(F.col("action")).alias("action"), F.col("at").cast("date").alias("at")
    ).where("list_name IS NOT NULL AND key IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')")
    settled = clean.groupBy("list_name", "key", "at").agg(F.max("action").alias("action"))
    nxt = F.lead("at").over(Window.partitionBy("list_name", "key").orderBy("at"))
    return (
        settled.withColumn("valid_to", F.coalesce(nxt, F.lit(FOREVER).cast("date")))
        .where("action = 'add'")
        .select("list_name", "key", F.col("at").alias("valid_from"), "valid_to")
    )


def host_timelines(hosts: DataFrame, intervals: DataFrame) -> DataFrame:
    """Segments host, seg_from, seg_to, matched_key, list_name, listed_since; segments of one host don't overlap.

    Of the entries active in a segment the longest key wins, then the latest valid_from, then the largest list_name.
    """
    # one parent domain may have a third of all hosts: its intervals are repeated so that its hosts spread over PARENT_SALT tasks
    keys = hosts.select("host", F.explode(host_suffixes(F.col("host"))).alias("key"), F.pmod(F.xxhash64("host"), F.lit(PARENT_SALT)).cast("int").alias("_part"))
    spread = intervals.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARENT_SALT - 1))))
    active = keys.join(spread, ["key", "_part"]).drop("_part")
    points = active.select("host", F.explode(F.array("valid_from", "valid_to")).alias("seg_from")).distinct()
    ends = points.withColumn("seg_to", F.lead("seg_from").over(Window.partitionBy("host").orderBy("seg_from"))).where("seg_to IS NOT NULL")
    covering = ends.join(active, "host").where("valid_from <= seg_from AND seg_from < valid_to")
    best = F.max(F.struct(F.length("key").alias("specificity"), "valid_from", "list_name", "key")).alias("best")
    return covering.groupBy("host", "seg_from", "seg_to").agg(best).select(
        "host", "seg_from", "seg_to", F.col("best.key").alias("matched_key"), F.col("best.list_name").alias("list_name"), F.col("best.valid_from").alias("listed_since")
    )


def filter_urls(captures: DataFrame, events: DataFrame, *, url: str = "url", fetched_at: str = "fetched_at") -> DataFrame:
    """``captures`` with host, matched_key, list_name, listed_since and blocked, judged by the list as it stood at fetch time.

    All rows and columns stay, repeated rows too. A null or hostless URL, or a null fetch time, matches nothing: blocked is
    false. Input columns named like one of the five added columns are replaced. An empty table gives an empty result.
    """
    added = ["host", "matched_key", "list_name", "listed_since", "blocked"]
    kept = captures.drop(*[c for c in added if c not in (url, fetched_at)])
    left = kept.withColumn("host", host_of(F.col(url)))
    hosts = captures.select(host_of(F.col(url)).alias("host")).where("host IS NOT NULL").distinct()
    # one host may have a third of all captures: its few segments are repeated so that its captures spread over SALT tasks
    segments = host_timelines(hosts, validity_intervals(events)).withColumnsRenamed({"host": "_seg_host", "seg_from": "_seg_from", "seg_to": "_seg_to"}).withColumn("_seg_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    # a null host would send every such capture to one task: they get keys that spread and match nothing
    key = F.coalesce(F.col("host"), F.concat(F.lit("\n"), F.xxhash64(F.col(fetched_at), F.col(url)).cast("string")))
    when = F.col(fetched_at).cast("date")
    salt = F.pmod(F.xxhash64(F.col(url), F.col(fetched_at)), F.lit(SALT)).cast("int")
    joined = left.withColumn("_host_key", key).withColumn("_salt", salt).join(
        segments, (F.col("_host_key") == F.col("_seg_host")) & (F.col("_salt") == F.col("_seg_salt")) & (when >= F.col("_seg_from")) & (when < F.col("_seg_to")), "left"
    )
    return joined.withColumn("blocked", F.col("matched_key").isNotNull()).drop("_host_key", "_seg_host", "_salt", "_seg_salt", "_seg_from", "_seg_to")
