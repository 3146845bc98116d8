"""Tables that change: upserts as joins, feed state from fetch history, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert_articles(old: DataFrame, new: DataFrame, key: str = "canonical_url") -> DataFrame:
    """``old`` with ``new`` merged by ``key``, and ``change`` (inserted, updated, kept).

    Title, topics, entities, bias and simhash come from the new row, summary and
    content are the longer ones, the first published time stays, a cluster id is
    taken when there is one; everything else stays. One full outer join. ``key``
    must be unique on either side; null keys match nothing.
    """
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    here, there = F.col(f"o.{key}").isNotNull() | F.col("o.id").isNotNull(), F.col("n.id").isNotNull()
    size = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))

    def pick(c: str) -> Column:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in ("title", "topics", "entities", "bias", "simhash"):
            value = b
        elif c in ("summary", "content"):
            value = F.when(size(f"n.{c}") > size(f"o.{c}"), b).otherwise(a)
        elif c == "published_at":
            value = F.coalesce(a, b)
        elif c == "cluster_id":
            value = F.when(F.coalesce(b, F.lit("")) != "", b).otherwise(a)
        else:
            value = a
        return F.when(here & there, value).when(here, a).otherwise(b).alias(c)

    change = F.when(here & there, "updated").when(here, "kept").otherwise("inserted")
    return both.select(*[pick(c) for c in old.columns], change.alias("change"))


def feed_runs(fetches: DataFrame) -> DataFrame:
    """Fetches with ``streak``: how many fetches of the feed have failed in a row up to this one (0 for a success).

    Fetches of equal time are in order of status. Feeds have few fetches a day, so a feed's history is one window partition.
    """
    w = Window.partitionBy("source_id").orderBy("fetched_at", "status")
    island = F.sum(F.when(F.col("status") == "error", 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = fetches.withColumn("_island", island)
    inside = Window.partitionBy("source_id", "_island").orderBy("fetched_at", "status").rowsBetween(Window.unboundedPreceding, 0)
    failed = F.sum(F.when(F.col("status") == "error", 1).otherwise(0)).over(inside)
    return df.withColumn("streak", F.when(F.col("status") == "error", failed).otherwise(0)).drop("_island")


def feed_state(fetches: DataFrame) -> DataFrame:
    """Per feed: last fetch, last success, its last known etag, error of the last fetch, failures in a row. Aggregates only."""
    at = F.struct("fetched_at", "status")
    good = F.col("status") != "error"
    last_good = F.max(F.when(good, F.col("fetched_at")))
    out = fetches.groupBy("source_id").agg(
        F.max("fetched_at").alias("last_fetch"), last_good.alias("last_success"), F.max_by("etag", F.when(F.col("etag").isNotNull(), at)).alias("etag"), F.max_by("status", at).alias("last_status"),
        F.max(F.when(good, at)).alias("_good"),
    )
    after = fetches.join(out.select(F.col("source_id").alias("_s"), "_good"), F.col("source_id") == F.col("_s"))
    fails = after.where(F.col("_good").isNull() | (at > F.col("_good"))).groupBy("source_id").agg(F.count("*").alias("failures"))
    return out.drop("_good").join(fails, "source_id", "left").withColumn("failures", F.coalesce("failures", F.lit(0)))


def due_feeds(sources: DataFrame, state: DataFrame, limit: int = 10) -> DataFrame:
    """Enabled sources whose feed hasn't failed ``limit`` times in a row; a feed without history has failed never."""
    known = state.select(F.col("source_id").alias("id"), "failures")
    return sources.where("enabled").join(known, "id", "left").withColumn("failures", F.coalesce("failures", F.lit(0))).where(F.col("failures") < limit)


def retained(df: DataFrame, time: Column, now: Column, days: int = 21) -> DataFrame:
    """Rows whose time isn't older than ``days``; rows without time stay."""
    return df.where(time.isNull() | (time >= F.timestamp_micros(F.unix_micros(now) - days * 86400 * 1000000)))


def unused(clusters: DataFrame, articles: DataFrame) -> DataFrame:
    """Clusters that no article has; blank ids count as none."""
    return clusters.join(articles.where("cluster_id <> ''").select("cluster_id"), "cluster_id", "left_anti")


def unknown(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key isn't stored."""
    return new.join(stored.select(key), key, "left_anti")


def keep_last(df: DataFrame, groups: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group in ``order``; Spark limits groups before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def stats(df: DataFrame, now: Column, time: str) -> DataFrame:
    """One row: rows, sources, newest time, rows of the last day."""
    day = F.timestamp_micros(F.unix_micros(now) - 86400 * 1000000)
    return df.agg(F.count("*").alias("n_articles"), F.countDistinct("source_id").alias("n_sources"), F.max(time).alias("newest"), F.count_if(F.col(time) >= day).alias("n_last_day"))
