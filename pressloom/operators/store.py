"""Stored tables beside the articles: sources, clusters, analysis, chat turns, payloads. Every change is a join that gives the new table; :func:`replaced` writes it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _merge(old: DataFrame, new: DataFrame, key: str, pick: Callable[[str, Column, Column], Column]) -> DataFrame:
    """Full outer join by ``key``; ``pick`` gives the value of a column that both sides have a row for. Null keys match nothing; keys must be unique."""
    o, n = old.withColumn("_o", F.lit(True)).alias("o"), new.withColumn("_n", F.lit(True)).alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    cols = []
    for c in old.columns:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}") if c in new.columns else F.lit(None)
        cols.append(F.when(F.col("o._o").isNotNull() & F.col("n._n").isNotNull(), pick(c, a, b) if c in new.columns else a).when(F.col("o._o").isNotNull(), a).otherwise(b).alias(c))
    return both.select(*cols)


def upserted_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with all columns overwritten by ``new``, by id; sources that the registry no longer has stay."""
    return _merge(old, new, "id", lambda c, a, b: b)


def upserted_clusters(old: DataFrame, new: DataFrame, fill_blank: bool = False) -> DataFrame:
    """Clusters by cluster_id: the new size and time; key_title stays, unless it is blank and ``fill_blank``."""

    def pick(c: str, a: Column, b: Column) -> Column:
        if c != "key_title":
            return b
        return F.when(F.coalesce(F.trim(a), F.lit("")) == "", b).otherwise(a) if fill_blank else a

    return _merge(old, new, "cluster_id", pick)


def with_clusters(articles: DataFrame, assigned: DataFrame, id_col: str = "id") -> DataFrame:
    """``articles`` with cluster_id from ``assigned`` (id, cluster_id) where there is one."""
    new = assigned.select(F.col(id_col).alias("_i"), F.col("cluster_id").alias("_c"))
    out = articles.join(new, F.col(id_col) == F.col("_i"), "left")
    return out.select(*[F.coalesce("_c", "cluster_id").alias(c) if c == "cluster_id" else F.col(c) for c in articles.columns])


def with_analysis(articles: DataFrame, analysis: DataFrame, id_col: str = "id") -> DataFrame:
    """``articles`` with topics, entities, bias and summary (those ``analysis`` has) replaced where it has a row."""
    given = [c for c in ("topics", "entities", "bias", "summary") if c in analysis.columns]
    new = analysis.select(F.col(id_col).alias("_i"), *[F.col(c).alias(f"_{c}") for c in given])
    out = articles.join(new, F.col(id_col) == F.col("_i"), "left")
    return out.select(*[F.when(F.col("_i").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in articles.columns])


def last_turns(turns: DataFrame, most: int = 12) -> DataFrame:
    """(session_id, place, id, role, content): the ``most`` newest turns of each session in the order they were said. Spark limits sessions before the shuffle."""
    newest = Window.partitionBy("session_id").orderBy(F.desc("id"))
    few = turns.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most)
    return few.select("session_id", F.row_number().over(Window.partitionBy("session_id").orderBy("id")).alias("place"), "id", "role", "content")


def asked_before(turns: DataFrame, terms: Column) -> DataFrame:
    """(session_id, asked_id, content): the latest user turn of each session that has ``terms`` (an array): what a follow-up takes over. One aggregate."""
    rows = turns.where((F.col("role") == "user") & (F.size(terms) > 0))
    return rows.groupBy("session_id").agg(F.max(F.struct("id", "content")).alias("m")).select("session_id", F.col("m.id").alias("asked_id"), "m.content")


def without_sessions(turns: DataFrame, gone: DataFrame) -> DataFrame:
    """``turns`` without those of the sessions in ``gone`` (session_id)."""
    return turns.join(gone.select("session_id").distinct(), "session_id", "left_anti")


def latest(df: DataFrame, order: list[Column]) -> DataFrame:
    """The first row in ``order``; empty for an empty table."""
    return df.orderBy(*order).limit(1)


def is_stale(generated: Column, now: Column, most_minutes: float = 720.0) -> Column:
    """Whether something is older than ``most_minutes``; without a readable time it is."""
    return F.coalesce((F.unix_micros(now) - F.unix_micros(generated)) / 6e7 > most_minutes, F.lit(True))


def session_id() -> str:
    """A new random session id of 16 hex digits."""
    return uuid.uuid4().hex[:16]


def append_rows(df: DataFrame, path: str, batch: str) -> None:
    """Add ``df`` to the table at ``path`` as ``batch``; a batch that comes again replaces itself."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def replaced(df: DataFrame, path: str) -> DataFrame:
    """Make ``df`` the table at ``path``: written beside it as a new version, then named as the current one in one small file, so readers see the old or the new table and never half of one."""
    spark = df.sparkSession
    version = uuid.uuid4().hex
    df.write.parquet(f"{path.rstrip('/')}/{version}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/current")
    return current(spark, path)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table that :func:`replaced` made last."""
    version = spark.read.json(f"{path.rstrip('/')}/current").first()["version"]
    return spark.read.parquet(f"{path.rstrip('/')}/{version}")
