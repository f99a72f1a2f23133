"""URL filters as a temporal join.

Dated list entries (key, list, action, at) become validity intervals of each
key: between two changes of a key the set of lists that hold it is constant. A
capture looks up its host, its domain and its host with the first path segment
by equality, and of each key's intervals takes the one that holds its fetch
time. Intervals of a key don't overlap, so a capture meets one at most and no
aggregation follows: a host with a third of all captures stays where it is
while the intervals are few enough to broadcast, and beyond that AQE can split
its side of the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import cut

#: Intervals up to which the table is broadcast (some 10 MB).
BROADCAST_INTERVALS = 100_000
HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#:]*)"
PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*/([^/?#]+)"


def intervals(entries: DataFrame) -> DataFrame:
    """(key, since, until, lists): the sorted lists that hold a key from since (included) to until (excluded, null: open).

    entries: key, list, action ('add' or 'remove'), at. Of changes of a list
    and key at one time 'remove' wins; adding again what is listed changes
    nothing; nulls and other actions are ignored.
    """
    e = entries.where("key is not null and list is not null and at is not null and action in ('add', 'remove')")
    e = e.groupBy("key", "list", "at").agg(F.max("action").alias("action"))
    w = Window.partitionBy("key", "list").orderBy("at")
    own = e.withColumn("until", F.lead("at").over(w)).where("action = 'add'").select("key", "list", F.col("at").alias("since"), "until")
    marks = own.select("key", F.col("since").alias("at")).union(own.where("until is not null").select("key", F.col("until").alias("at"))).distinct()
    spans = marks.withColumn("next", F.lead("at").over(Window.partitionBy("key").orderBy("at")))
    held = spans.join(own, "key").where("since <= at and (until is null or at < until)")
    return held.groupBy("key", F.col("at").alias("since"), F.col("next").alias("until")).agg(F.sort_array(F.collect_set("list")).alias("lists"))


def filter_captures(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched") -> DataFrame:
    """Adds to each capture _host, _lists (that hold a key of it at its fetch time, sorted) and _blocked.

    All columns and rows are kept, repeated ones too. A null url or fetch time
    matches nothing; an empty table of either gives empty lists.
    """
    span = cut(intervals(entries))
    few = span.count() <= BROADCAST_INTERVALS
    c = captures.select(F.struct("*").alias("row"), F.col(url).alias("url"), F.col(at).alias("fetched"))
    c = c.withColumn("host", F.nullif(F.lower(F.regexp_extract("url", HOST, 1)), F.lit("")))
    c = c.withColumn("k0", F.col("host")).withColumn("k1", F.nullif(F.regexp_extract("host", r"\.([^.]+\.[^.]+)$", 1), F.lit(""))).withColumn("k2", F.concat("host", F.lit("/"), F.nullif(F.regexp_extract("url", PATH, 1), F.lit(""))))
    for k in range(3):
        s = span.toDF(f"key{k}", f"since{k}", f"until{k}", f"lists{k}")
        on = (F.col(f"k{k}") == F.col(f"key{k}")) & (F.col("fetched") >= F.col(f"since{k}")) & (F.col(f"until{k}").isNull() | (F.col("fetched") < F.col(f"until{k}")))
        c = c.join(F.broadcast(s) if few else s, on, "left")
    empty = F.array().cast("array<string>")
    lists = F.sort_array(F.array_distinct(F.concat(*[F.coalesce(f"lists{k}", empty) for k in range(3)])))
    return c.select("row.*", F.col("host").alias("_host"), lists.alias("_lists"), (F.size(lists) > 0).alias("_blocked"))
