"""New batches against everything accepted before: duplicates by address, hash or near-equal title.

A title is the set of its words. Its band keys are minima under one fixed
permutation of the words: by the level of the word's document frequency, rarest
first, then by hash. With an overlap of ``threshold`` two sets share at least
ceil(threshold * size) words, so their two least common words are among the
first size - ceil(threshold * size) + 2 words of either set: the pairs of those
words are the keys, and no pair of similar titles is lost. (Keys from uniformly
random permutations would meet at the phrases that thousands of headlines share;
see the README.) With each key go a signature of the set, its size and 256 bits
of its words, which refutes most candidates exactly; the rest is verified with
the word sets.

The index is three tables, each partitioned by the bucket of its key, so a batch
reads the buckets of its own keys and, of classes and sets, those of the
candidates. Buckets are sized to the rows of the history, so the part that is
read falls with the batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.schemas import fields
from pressloom.session import spool

LONG = 32  # sets of more words use keys of one word, so keys grow with the size and not its square; both kinds lose no pair
KINDS = ("url", "hash", "title")


def word_set(text: Column) -> Column:
    """Distinct hashed words of a text; null has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda w: F.xxhash64(w))))


def word_levels(sets: DataFrame, column: str) -> DataFrame:
    """(word, level): floor(log2(document frequency)). Frozen when an index is built; words it lacks are of level 0."""
    return sets.select(F.explode(column).alias("word")).groupBy("word").agg(F.floor(F.log2(F.count("*"))).cast("int").alias("level"))


def ordered_sets(classes: DataFrame, levels: DataFrame, key: str, column: str, usual: int) -> DataFrame:
    """``classes`` (key, column) with ``ranked``, the words of a set in the order of the permutation.

    Words from level ``usual`` on are few and their levels are broadcast, so the
    commonest words aren't shuffled; the others are joined by word.
    """
    rows = classes.select(key, F.explode(column).alias("word"))
    often = F.broadcast(levels.where(F.col("level") >= usual))
    rare = rows.join(often, "word", "left_anti").join(levels.where((F.col("level") > 0) & (F.col("level") < usual)), "word", "left")
    item = F.struct(F.coalesce("level", F.lit(0)).alias("level"), "word")
    both = rows.join(often, "word").select(key, "word", "level").unionByName(rare.select(key, "word", "level"))
    return both.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["word"]).alias("ranked"))


def band_keys(ranked: Column, threshold: float) -> Column:
    """The keys of a ranked word set."""
    n = F.size(ranked)
    need = F.ceil(n * threshold - 1e-9).cast("int")
    single = F.transform(F.slice(ranked, 1, F.greatest(n - need + 1, F.lit(0))), lambda w: F.xxhash64(w, F.lit("one")))
    head = F.slice(ranked, 1, F.least(n, F.greatest(n - need + 2, F.lit(0))))
    double = F.flatten(F.transform(head, lambda w, i: F.transform(F.slice(head, i + 2, F.size(head)), lambda v: F.xxhash64(w, v))))
    none = F.array().cast("array<bigint>")
    return F.concat(F.when((n > 1) & (n <= LONG), double).otherwise(none), F.when(n >= int(threshold * LONG), single).otherwise(none))


def overlap(left: Column, right: Column) -> Column:
    common = F.size(F.array_intersect(left, right))
    return common / (F.size(left) + F.size(right) - common)


MARKS = tuple(f"m{i}" for i in range(4))  # columns of a signature


def signature(ranked: Column) -> list[Column]:
    """Columns of 64 bits each, one bit set for each word: most pairs that are too far apart differ in them."""
    place = lambda w: F.pmod(w, F.lit(64 * len(MARKS))).cast("int")
    one = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), place(w) % 64)
    part = lambda i: F.aggregate(F.filter(ranked, lambda w: F.floor(place(w) / 64) == i), F.lit(0).cast("long"), lambda a, w: a.bitwiseOR(one(w)))
    return [part(i).alias(c) for i, c in enumerate(MARKS)]


def possible(a: str, b: str, threshold: float) -> Column:
    """Whether sizes and signatures (columns n, m0.. with the suffixes ``a`` and ``b``) allow the overlap: a bit that only one set has is a word that only this set has."""
    alone = lambda x, y: sum((F.bit_count(F.col(c + x).bitwiseAND(F.bitwise_not(F.col(c + y)))) for c in MARKS), F.lit(0))
    na, nb = F.col("n" + a), F.col("n" + b)
    return F.least(na - alone(a, b), nb - alone(b, a)) * (1 + threshold) >= (na + nb) * threshold - 1e-6


def prepared(articles: DataFrame) -> DataFrame:
    """(id, run_no, words, keys): keys are (kind, key, check) of the address, the content hash and the word set of the title, two independent 64-bit hashes each; null, blank and wordless values have none."""
    words = word_set(F.col("title"))
    text = lambda c: F.when(F.trim(c) != "", F.col(c))
    values = ((k, v) for k, v in zip(KINDS, (text("canonical_url"), text("content_hash"), F.when(F.size(words) > 0, F.array_join(words.cast("array<string>"), " ")))))
    keys = F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("kind"), F.xxhash64(v).alias("key"), F.xxhash64(v, F.lit("check")).alias("check"))) for k, v in values])
    return articles.select(F.col("id").cast("long").alias("id"), F.col("run_no").cast("long").alias("run_no"), words.alias("words"), F.filter(keys, lambda x: x.isNotNull()).alias("keys"))


def _entries(rows: DataFrame) -> DataFrame:
    return rows.select("id", "run_no", F.explode("keys").alias("k")).select("id", "run_no", "k.kind", "k.key", "k.check")


def _classes(rows: DataFrame) -> DataFrame:
    """(class_id, words) of the different titles."""
    keyed = rows.select(F.explode("keys").alias("k"), "words").where(F.col("k.kind") == "title")
    return keyed.groupBy(F.col("k.key").alias("class_id")).agg(F.first("words").alias("words"))


class HistoryIndex:
    """Keys of all accepted articles, kept as tables in ``path``.

    ``levels`` holds the frozen word levels, ``exact`` the (kind, key, check, id,
    run_no) of articles, ``titles`` the band keys with signatures, ``sets`` the
    word sets of title classes. The last three lie in folders by batch and
    bucket. A batch that is appended again after a failure replaces its own
    folders, so appending is idempotent; it rewrites nothing else.
    """

    TABLES = {
        "exact": fields("id long, run_no long, kind string, key long, check long, batch string, bucket int"),
        "titles": fields("key long, class_id long, n int, " + "".join(f"{c} long, " for c in MARKS) + "batch string, bucket int"),
        "sets": fields("class_id long, ranked long[], batch string, bucket int"),
    }

    def __init__(self, spark: SparkSession, path: str, threshold: float = 0.6):
        if threshold <= 0.5:
            raise ValueError("keys of two words need a threshold above 0.5")
        self.spark, self.path, self.threshold = spark, path.rstrip("/"), threshold

    def _settings(self) -> tuple[int, int]:
        if not hasattr(self, "_known"):
            row = self.spark.read.parquet(f"{self.path}/settings").first()
            self._known = (row["buckets"], row["usual"])
        return self._known

    def _placed(self, df: DataFrame, key: str) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.col(key), F.lit(self._settings()[0])).cast("int"))

    def _title_tables(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(titles, sets) of the classes of ``rows``."""
        levels = self.spark.read.parquet(f"{self.path}/levels")
        sets = spool(ordered_sets(_classes(rows), levels, "class_id", "words", self._settings()[1]), "ranked")
        titles = sets.select("*", F.size("ranked").alias("n"), *signature(F.col("ranked"))).select(F.explode(band_keys(F.col("ranked"), self.threshold)).alias("key"), "class_id", "n", *MARKS)
        return self._placed(titles, "key"), self._placed(sets, "class_id")

    def build(self, articles: DataFrame, bucket_rows: int = 50_000, batch: str = "first", usual_share: float = 0.001) -> HistoryIndex:
        """A new index of ``articles``, with the word levels of their titles and buckets of about ``bucket_rows`` articles.

        Words that ``usual_share`` of all articles have are at most (mean words of a title) / share; their levels are broadcast.
        """
        rows = spool(prepared(articles), "history")
        return self._start(rows, bucket_rows, usual_share)._append(rows, batch)

    def _start(self, rows: DataFrame, bucket_rows: int = 50_000, usual_share: float = 0.001) -> HistoryIndex:
        total = rows.count()
        word_levels(rows, "words").write.mode("overwrite").parquet(f"{self.path}/levels")
        self._known = (max(16, -(-total // bucket_rows)), max(1, int(total * usual_share)).bit_length())
        self.spark.createDataFrame([self._known], "buckets int, usual int").write.mode("overwrite").parquet(f"{self.path}/settings")
        return self

    def append(self, articles: DataFrame, batch: str) -> HistoryIndex:
        """Add accepted articles as ``batch``."""
        return self._append(spool(prepared(articles), "batch"), batch)

    def _append(self, rows: DataFrame, batch: str, tables: tuple[DataFrame, DataFrame] | None = None) -> HistoryIndex:
        titles, sets = tables or self._title_tables(rows)
        for name, table in zip(self.TABLES, (self._placed(_entries(rows), "key"), titles, sets)):
            salt = F.pmod(F.xxhash64("class_id" if name != "exact" else "id"), F.lit(4))  # a hot bucket is written by four tasks
            table.repartition("bucket", salt).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/batch={batch}")
        return self

    def _read(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows of the buckets that ``keys`` has; the bucket numbers, at most as many as there are buckets, come to the driver."""
        wanted = [r["bucket"] for r in keys.select("bucket").distinct().collect()]
        return self.spark.read.schema(self.TABLES[name]).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}").where(F.col("bucket").isin(wanted))

    def links(self, titles: DataFrame, sets: DataFrame) -> DataFrame:
        """(a, b): title classes of the index and different ones of a batch (its two tables) with the overlap."""
        x, y = (t.select("key", F.col("class_id").alias(side), *[F.col(c).alias(c + side) for c in ("n", *MARKS)]) for t, side in ((self._read("titles", titles), "a"), (titles, "b")))
        near = (F.col("a") != F.col("b")) & possible("a", "b", self.threshold)
        pairs = spool(x.join(y, "key").where(near).select("a", "b").distinct(), "candidates")
        known = self._read("sets", self._placed(pairs.select("a").distinct(), "a")).select(F.col("class_id").alias("a"), F.col("ranked").alias("ra")).dropDuplicates(["a"])
        both = pairs.join(known, "a").join(sets.select(F.col("class_id").alias("b"), F.col("ranked").alias("rb")), "b")
        return both.where(overlap(F.col("ra"), F.col("rb")) >= self.threshold).select("a", "b")

    def probe(self, batch: DataFrame) -> DataFrame:
        """(earlier_id, later_id) for the articles of ``batch`` that an accepted one of an earlier run equals or nearly equals.

        Null, blank and wordless values match nothing; rows of null run_no have no
        order and no pair. Equal titles are one class and only classes are
        compared. Ids must be unique.
        """
        rows = spool(prepared(batch), "batch")
        return self._probe(rows, self._title_tables(rows))

    def _probe(self, rows: DataFrame, tables: tuple[DataFrame, DataFrame]) -> DataFrame:
        entries = self._placed(_entries(rows), "key")
        known = self._read("exact", entries).select("kind", "key", "check", F.col("id").alias("earlier_id"), F.col("run_no").alias("r1"))
        same = known.join(entries.select("kind", "key", "check", F.col("id").alias("later_id"), F.col("run_no").alias("r2")), ["kind", "key", "check"])
        links = spool(self.links(*tables), "links")
        of_class = self._read("exact", self._placed(links.select("a").distinct(), "a")).where("kind = 'title'")
        old = of_class.select(F.col("key").alias("a"), F.col("id").alias("earlier_id"), F.col("run_no").alias("r1"))
        new = entries.where("kind = 'title'").select(F.col("key").alias("b"), F.col("id").alias("later_id"), F.col("run_no").alias("r2"))
        near = links.join(new, "b").join(old, "a")
        pick = lambda df: df.where("r1 < r2").select("earlier_id", "later_id")
        return pick(same).union(pick(near)).distinct()

    def accept(self, articles: DataFrame, batch: str) -> DataFrame:
        """The repeats in ``articles``; the rows that repeat nothing are appended as ``batch``.

        The pairs are written before the index grows, so a second call with the
        same batch, after a failure, gives the same result.
        """
        found = spool(self.probe(articles), "repeats")
        self.append(articles.join(found.select(F.col("later_id").alias("id")), "id", "left_anti"), batch)
        return found


def repeats(articles: DataFrame, path: str, threshold: float = 0.6) -> DataFrame:
    """All pairs (earlier_id, later_id) of articles of different runs with the same address, hash or a title overlap of ``threshold``.

    The whole history is stored in one index at ``path``, then every run probes it for earlier ones.
    """
    index, rows, tables = _whole(articles, path, threshold)
    return index._probe(rows, tables)


def _whole(articles: DataFrame, path: str, threshold: float) -> tuple[HistoryIndex, DataFrame, tuple[DataFrame, DataFrame]]:
    """An index of all ``articles``, their prepared rows and title tables, each made once."""
    rows = spool(prepared(articles), "history")
    index = HistoryIndex(articles.sparkSession, path, threshold)._start(rows)
    tables = index._title_tables(rows)
    return index._append(rows, "first", tables), rows, tables


def last_run_against_history(articles: DataFrame, path: str) -> DataFrame:
    """The newest run against an index of all earlier runs; what repeats nothing is appended."""
    newest = articles.agg(F.max("run_no").alias("newest"))
    marked = articles.join(F.broadcast(newest))  # one row
    index = HistoryIndex(articles.sparkSession, path).build(marked.where("run_no < newest").drop("newest"))
    return index.accept(marked.where("run_no = newest").drop("newest"), "newest")


def earlier_counts(articles: DataFrame, path: str, threshold: float = 0.6) -> DataFrame:
    """One row an article: article_id, title_class, and how many articles of earlier runs have its address, its hash, its title, or a similar title (n_url, n_hash, n_title, n_near).

    Nothing is spelled out in pairs: articles are counted by (key, run), running
    sums go over the runs of a key, and links are between title classes. A null
    run_no has no earlier run.
    """
    index, rows, tables = _whole(articles, path, threshold)
    entries = _entries(rows)
    per_run = spool(entries.where("run_no is not null").groupBy("kind", "key", "check", "run_no").agg(F.count("*").alias("n")), "per_run")
    before = per_run.alias("x").join(per_run.alias("y"), ["kind", "key", "check"]).where("y.run_no < x.run_no").groupBy("kind", "key", "check", "x.run_no").agg(F.sum("y.n").alias("n"))
    of_kind = entries.join(before, ["kind", "key", "check", "run_no"], "left").groupBy("id").agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"n_{k}") for k in KINDS], F.max(F.when(F.col("kind") == "title", F.col("key"))).alias("title_class")
    )
    links = index.links(*tables)
    titles = per_run.where("kind = 'title'").select("key", "run_no", "n")
    near = links.join(titles.toDF("a", "r1", "n1"), "a").join(titles.select(F.col("key").alias("b"), F.col("run_no").alias("r2")), "b").where("r1 < r2").groupBy("b", "r2").agg(F.sum("n1").alias("n_near"))
    out = articles.select("id", "run_no").join(of_kind, "id", "left").join(near, (F.col("title_class") == F.col("b")) & (F.col("run_no") == F.col("r2")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("id").alias("article_id"), "title_class", *[zero(f"n_{k}") for k in KINDS], zero("n_near"))
