"""URL filters by a temporal list join, in DataFrame operations only.

List entries are dated: an entry (list, verdict, kind, key) is added or removed at a
time. Consecutive events of an entry become validity intervals, closed at the start
and open at the end. Every capture is expanded to the keys it can match: its URL
without fragment, its host, and each domain above the host. An equi-join on the key
with the interval around the fetch time is the as-of join; Spark broadcasts the
intervals if they are small and splits skewed keys if not. Equal captures (same URL
and time) are evaluated once.

Kinds: ``url`` matches the URL without its fragment, scheme and host lower-cased;
``host`` the host alone; ``domain`` the host and all hosts below it. An active
``allow`` entry outweighs active ``block`` entries.

Defined results: a null or unparseable URL, or a null time, matches nothing and is
not blocked; events with nulls are passed over; of several events of an entry at one
time, ``remove`` wins; an event that repeats the state changes nothing; empty lists
block nothing; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]+)"
ENTRY = ["list", "verdict", "kind", "key"]


def url_host(url: Column) -> Column:
    """Lower-cased host without a final dot, '' if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", "")


def url_key(url: Column) -> Column:
    """The URL without fragment, scheme and host in lower case."""
    bare = F.regexp_replace(url, r"#[\s\S]*", "")
    head = F.regexp_extract(bare, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*", 0)
    return F.concat(F.lower(head), F.substr(bare, F.length(head) + 1))


def validity_intervals(events: DataFrame) -> DataFrame:
    """``events(list, verdict, kind, key, action, at)`` -> one row per time span in which an
    entry is active: ``(list, verdict, kind, key, valid_from, valid_to)``."""
    whole = events.dropna(subset=[*ENTRY, "action", "at"])
    state = whole.groupBy(*ENTRY, "at").agg(F.min(F.col("action") == "add").alias("on"))
    history = Window.partitionBy(*ENTRY).orderBy("at")
    changes = state.withColumn("before", F.lag("on", 1, False).over(history)).where("on <> before")
    spans = changes.withColumn("valid_to", F.lead("at").over(history)).where("on")
    return spans.select(*ENTRY, F.col("at").alias("valid_from"), "valid_to")


def capture_keys(captures: DataFrame) -> DataFrame:
    """Distinct ``(url, fetched_at)`` with the ``(kind, key)`` pairs they can match."""
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key")))
    plain = F.array(F.struct(F.lit("url").alias("kind"), url_key(F.col("url")).alias("key")), F.struct(F.lit("host").alias("kind"), F.col("host").alias("key")))
    return (captures.where("url is not null and fetched_at is not null").select("url", "fetched_at").distinct()
            .withColumn("host", url_host(F.col("url"))).where("host <> ''").select("url", "fetched_at", F.inline(F.concat(plain, domains))))


def filter_urls(captures: DataFrame, events: DataFrame) -> DataFrame:
    """``captures(page_id, url, fetched_at)`` against dated entries: per row ``page_id,
    url, fetched_at, n_block, n_allow, lists`` (sorted names of lists with an active
    match, comma-joined) and ``blocked``."""
    spans = validity_intervals(events)
    at = F.col("fetched_at")
    active = (capture_keys(captures).join(spans, ["kind", "key"])
              .where((at >= F.col("valid_from")) & (F.col("valid_to").isNull() | (at < F.col("valid_to")))))
    found = active.groupBy("url", "fetched_at").agg(
        F.count(F.when(F.col("verdict") == "block", 1)).alias("n_block"), F.count(F.when(F.col("verdict") == "allow", 1)).alias("n_allow"),
        F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"))
    out = captures.select("page_id", "url", "fetched_at").join(found, ["url", "fetched_at"], "left")
    n_block, n_allow = (F.coalesce(c, F.lit(0)).cast("bigint") for c in ("n_block", "n_allow"))
    return out.select("page_id", "url", "fetched_at", n_block.alias("n_block"), n_allow.alias("n_allow"),
                      F.coalesce("lists", F.lit("")).alias("lists"), ((n_block > 0) & (n_allow == 0)).alias("blocked"))
