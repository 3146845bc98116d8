"""Stories: articles of one event, by headline words, entities and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pressloom.functions import text as X
from pressloom.operators.components import components
from pressloom.session import cut

# Thresholds of two headlines for one story.
SURE, LIKELY, ENTITIES, HOURS = 0.62, 0.42, 0.34, 48


def same_story(sa: Column, sb: Column, ea: Column, eb: Column) -> Column:
    """Containment of the headline words from 0.62; from 0.42 with an entity overlap of 0.34."""
    c = X.containment(sa, sb)
    return (c >= SURE) | ((c >= LIKELY) & (X.jaccard(ea, eb) >= ENTITIES))


def headline_groups(df: DataFrame, id_col: str, title: str, entities: str, time: Column, hours: int = HOURS) -> tuple[DataFrame, DataFrame]:
    """(groups: gid, b, s, e, low, high; members: id, t, gid): the articles whose headlines have the same words, with the same entities, in one window of ``hours``.

    They are of one story with each other, so any number of copies is one row
    while candidates are sought. ``gid`` is the least id, ``low`` and ``high`` the
    first and last time. Rows without words or time are in neither table.
    """
    names = F.transform(F.coalesce(F.col(entities), F.array().cast("array<string>")), F.lower)
    rows = df.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(X.tokens(F.col(title)))).alias("s"), F.array_sort(F.array_distinct(names)).alias("e"), time.alias("t"))
    rows = rows.where(F.col("t").isNotNull() & (F.size("s") > 0)).withColumn("b", F.floor(F.unix_micros("t") / (hours * 3_600_000_000)))
    groups = rows.groupBy("b", "s", "e").agg(F.min("id").alias("gid"), F.min("t").alias("low"), F.max("t").alias("high"))
    members = rows.join(groups.select("b", "s", "e", "gid"), ["b", "s", "e"]).select("id", "t", "gid")
    return cut(groups), members


def group_links(groups: DataFrame, hours: int = HOURS) -> DataFrame:
    """(x, y), x < y: groups of one story with a pair of articles within ``hours``.

    Two headlines of one story have ceil(LIKELY * size) words of the smaller one
    in common, so one of its size - ceil(LIKELY * size) + 1 rarest words is in
    the other. Those are its keys, with its window; the other one is asked with
    all its words in its own window and its neighbours. No word is left out, and
    however long the history, a word meets what lies within three windows.
    """
    word = groups.select("gid", "b", F.size("s").alias("n"), F.explode("s").alias("w"))
    often = word.groupBy("w").agg(F.count("*").alias("df"))
    order = F.transform(F.array_sort(F.collect_list(F.struct("df", "w"))), lambda r: r["w"])
    ranked = word.join(often, "w").groupBy("gid", "b", "n").agg(order.alias("r"))
    few = F.slice("r", 1, (F.col("n") - F.ceil(F.col("n") * LIKELY - 1e-9) + 1).cast("int"))
    small = ranked.select(F.col("gid").alias("p"), F.col("n").alias("np"), F.col("b").alias("k"), F.explode(few).alias("w"))
    large = word.select(F.col("gid").alias("q"), F.col("n").alias("nq"), F.explode(F.sequence(F.col("b") - 1, F.col("b") + 1)).alias("k"), "w")
    met = small.join(large, ["w", "k"]).where((F.col("p") != F.col("q")) & (F.col("np") <= F.col("nq")))
    pairs = met.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct()
    side = lambda g: groups.select(F.col("gid").alias(g), *[F.col(c).alias(c + g) for c in ("s", "e", "low", "high")])
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    apart = F.greatest(F.unix_micros("lowx") - F.unix_micros("highy"), F.unix_micros("lowy") - F.unix_micros("highx"))
    return both.where((apart <= hours * 3_600_000_000) & same_story(F.col("sx"), F.col("sy"), F.col("ex"), F.col("ey"))).select("x", "y")


def story_pairs(df: DataFrame, id_col: str, title: str, entities: str, time: Column, hours: int = HOURS) -> DataFrame:
    """(a, b), a < b: all pairs of articles of one story within ``hours``. Rows without words or time have no pair."""
    groups, members = headline_groups(df, id_col, title, entities, time, hours)
    links = group_links(groups, hours)
    end = lambda g, i: members.select(F.col("gid").alias(g), F.col("id").alias(i), F.col("t").alias("t" + i))
    across = links.join(end("x", "i"), "x").join(end("y", "j"), "y").where(F.abs(F.unix_micros("ti") - F.unix_micros("tj")) <= hours * 3_600_000_000).select("i", "j")
    within = end("g", "i").join(end("g", "j"), "g").where("i < j").select("i", "j")
    return across.union(within).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))


def stories(df: DataFrame, id_col: str, title: str, entities: str, time: Column, hours: int = HOURS) -> DataFrame:
    """(id, story): the least id of the story each article is in; a single article is its own. Links are between groups of equal headlines, never spelled out for articles."""
    groups, members = headline_groups(df, id_col, title, entities, time, hours)
    label = components(group_links(groups, hours).select(F.col("x").alias("src"), F.col("y").alias("dst")))
    placed = members.join(label.withColumnRenamed("node", "gid"), "gid", "left").select("id", F.coalesce("component", "gid").alias("story"))
    return df.select(F.col(id_col).alias("id")).join(placed, "id", "left").select("id", F.coalesce("story", "id").alias("story"))


def story_ids(members: DataFrame, urls: DataFrame) -> DataFrame:
    """(id, story, cluster_id, size): a digest of the addresses of a story, the same for any order of rows.

    It is taken over the sum of the addresses' MD5 (its first 60 bits), so a large story isn't gathered.
    """
    code = F.conv(F.substring(F.md5(F.coalesce("canonical_url", F.lit(""))), 1, 15), 16, 10).cast("decimal(38,0)")
    digest = members.join(urls, "id").groupBy("story").agg(F.sum(code).alias("d"), F.count("*").alias("n"))
    named = digest.select("story", F.substring(F.sha2(F.concat_ws(":", F.col("d").cast("string"), "n"), 256), 1, 16).alias("cluster_id"), F.col("n").alias("size"))
    return members.join(named, "story").select("id", "story", "cluster_id", "size")


def recluster(df: DataFrame, id_col: str, title: str, entities: str, time: Column, now: Column, url: str = "canonical_url", lookback: int = HOURS) -> DataFrame:
    """(id, story, cluster_id, size) of the articles of the last ``lookback`` hours before ``now``: what a batch step does after each ingest, at the cost of the window and not of the history."""
    recent = df.where((time >= F.timestamp_micros(F.unix_micros(now) - lookback * 3_600_000_000)) & (time <= now))
    return story_ids(stories(recent, id_col, title, entities, time), recent.select(F.col(id_col).alias("id"), F.col(url).alias("canonical_url")))


def story_groups(df: DataFrame, id_col: str, cluster: str, time: Column, most: int = 12) -> DataFrame:
    """(cluster, lead_id, n_members, n_sources, related): the newest article of each story and the ids of at most ``most`` others, newest first.

    Counts are plain aggregates; only the first ``most`` + 1 rows of a story,
    limited before the shuffle, are gathered. Null and blank clusters are left out.
    """
    rows = df.where(F.coalesce(cluster, F.lit("")) != "").select(F.col(cluster), F.col(id_col).alias("id"), "source_id", time.alias("t"))
    sizes = rows.groupBy(cluster).agg(F.count("*").alias("n_members"), F.countDistinct("source_id").alias("n_sources"))
    w = Window.partitionBy(cluster).orderBy(F.desc_nulls_last("t"), "id")
    few = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most + 1)
    ids = few.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("ids"))
    return sizes.join(ids, cluster).select(cluster, F.get("ids", F.lit(0)).alias("lead_id"), "n_members", "n_sources", F.slice("ids", 2, most).alias("related"))
