"""A stored inverted index: built once, kept up by batches, read by bucket for a question.

``postings`` holds (word, id, column, places) in folders by batch and bucket; a
bucket is that of a word's first four characters, so a word and every prefix of
four or more lie in one bucket and a question reads as many buckets as it has
words. ``lengths`` holds (id, time, length), ``gone`` the ids that were removed
and the batch from which on they count again. A batch that comes again replaces
its own folders.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.schemas import fields
from pressloom.search.ranking import Phrase, index_words
from pressloom.session import spool

PREFIX = 4
POSTINGS = fields("word string, id long, column string, places int[], batch int, bucket int")
LENGTHS = fields("id long, time timestamp, length int, batch int")
GONE = fields("id long, upto int, batch int")


INVERTED = fields("word string, id long, column string, places int[]")


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, id, column, places) of the rows (id, column, words)."""
    for batch in batches:
        words, ids, columns, places, ends = [], [], [], [], [0]
        for i, column, found in zip(*(batch.column(k).to_pylist() for k in range(3))):
            at: dict[str, list[int]] = {}
            for k, w in enumerate(found):
                at.setdefault(w, []).append(k)
            words += at
            ids += [i] * len(at)
            columns += [column] * len(at)
            for p in at.values():
                places += p
                ends.append(len(places))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(ids, pa.int64()), pa.array(columns, pa.string()), lists], names=INVERTED.names)


class SearchIndex:
    """An index in ``path`` over ``weights`` (column -> weight); ``buckets`` folders a batch."""

    def __init__(self, spark: SparkSession, path: str, weights: dict[str, float], buckets: int = 64):
        self.spark, self.path, self.weights, self.buckets = spark, path.rstrip("/"), weights, buckets

    def add(self, df: DataFrame, batch: int, time: str, id_col: str = "id") -> SearchIndex:
        """Index the rows of ``df`` as ``batch`` (a number that grows). Rows that are there already from an earlier batch are replaced by the new ones."""
        kinds, first = dict(df.dtypes), not self._exists("postings")
        words = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), index_words(F.array_join(F.col(c), " ") if kinds[c].startswith("array") else F.col(c)).alias("w")) for c in self.weights]))
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(time).alias("time"), words.alias("c"))
        lists = rows.select("id", "c.column", "c.w").mapInArrow(_inverted, INVERTED)  # a field is inverted where it is, without a shuffle
        bucket = F.pmod(F.xxhash64(F.substring("word", 1, PREFIX)), F.lit(self.buckets)).cast("int")
        lists.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("bucket", "word").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/batch={batch}")
        rows.groupBy("id", "time").agg(F.sum(F.size("c.w")).cast("int").alias("length")).write.mode("overwrite").parquet(f"{self.path}/lengths/batch={batch}")
        replaced = df.select(F.col(id_col).alias("id"))
        return self.remove(replaced.limit(0) if first else replaced, batch)

    def _exists(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def remove(self, ids: DataFrame, batch: int) -> SearchIndex:
        """Forget what batches before ``batch`` have of ``ids``."""
        ids.select(F.col("id").cast("long").alias("id"), F.lit(batch).alias("upto")).distinct().write.mode("overwrite").parquet(f"{self.path}/gone/batch={batch}")
        return self

    def _live(self, name: str, schema, where: Column | None = None) -> DataFrame:
        df = self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        df = df if where is None else df.where(where)
        gone = self.spark.read.schema(GONE).option("basePath", f"{self.path}/gone").parquet(f"{self.path}/gone").groupBy(F.col("id").alias("_i")).agg(F.max("upto").alias("_upto"))
        return df.join(gone, (F.col("id") == F.col("_i")) & (F.col("batch") < F.col("_upto")), "left_anti")

    def figures(self) -> DataFrame:
        """(_rows, _avg): one row with the number of indexed rows and their mean length."""
        return self._live("lengths", LENGTHS).agg(F.count("*").alias("_rows"), F.avg("length").alias("_avg"))

    def _rows(self, phrases: list[Phrase]) -> DataFrame:
        """The postings of all words of ``phrases``, from the buckets of those words only; stored, for each phrase looks at them."""
        words = sorted({(w, p.prefix and k == len(p.words) - 1) for p in phrases for k, w in enumerate(p.words)})
        if any(prefix and len(w) < PREFIX for w, prefix in words):
            raise ValueError(f"a prefix needs {PREFIX} characters")
        at = self.spark.range(1).select(*[F.pmod(F.xxhash64(F.lit(w[:PREFIX])), F.lit(self.buckets)).cast("int") for w, _ in words]).first()
        hit = reduce(lambda a, b: a | b, [F.col("word").startswith(w) if prefix else F.col("word") == w for w, prefix in words])
        return spool(self._live("postings", POSTINGS, F.col("bucket").isin(sorted(set(at))) & hit), "postings")

    @staticmethod
    def _of(rows: DataFrame, word: str, prefix: bool, k: int) -> DataFrame:
        """(id, column, places less ``k``) of one word or prefix."""
        found = rows.where(F.col("word").startswith(word) if prefix else F.col("word") == word)
        shifted = F.transform("places", lambda p: p - k)
        if not prefix:
            return found.select("id", "column", shifted.alias("places"))
        return found.groupBy("id", "column").agg(F.flatten(F.collect_list(shifted)).alias("places"))

    def matches(self, phrases: list[Phrase]) -> DataFrame:
        """(id, _time, _len, _tf_0...): the rows with one of ``phrases`` and the weighted occurrences of each, like a scan would count them."""
        parts, rows = [], self._rows(phrases)
        weight = reduce(lambda a, c: F.when(F.col("column") == c, self.weights[c]).otherwise(a), self.weights, F.lit(0.0))
        for i, p in enumerate(phrases):
            found = None
            for k, w in enumerate(p.words):
                now = self._of(rows, w, p.prefix and k == len(p.words) - 1, k)
                found = now if found is None else found.join(now.withColumnRenamed("places", "_p"), ["id", "column"]).select("id", "column", F.array_intersect("places", "_p").alias("places"))
            parts.append(found.select("id", F.lit(i).alias("i"), (F.size("places") * weight).alias("tf")).where("tf > 0"))
        every = reduce(lambda a, b: a.unionByName(b), parts)
        wide = every.groupBy("id").agg(*[F.coalesce(F.sum(F.when(F.col("i") == i, F.col("tf"))), F.lit(0.0)).alias(f"_tf_{i}") for i in range(len(phrases))])
        lengths = self._live("lengths", LENGTHS).select("id", F.col("time").alias("_time"), F.col("length").alias("_len"))
        return spool(wide.join(lengths, "id"), "matches")
