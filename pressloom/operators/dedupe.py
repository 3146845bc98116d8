"""Exact and near duplicates of articles."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.functions import text as X
from pressloom.operators.components import components
from pressloom.session import cut

BITS = 60


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks of all choices of ``blocks`` - ``distance`` of ``blocks`` parts of a hash: at most ``distance`` bits apart, two hashes agree under one of them."""
    size = -(-BITS // blocks)
    part = [((1 << min(size, BITS - i * size)) - 1) << (i * size) for i in range(blocks)]
    return [sum(part[i] for i in chosen) for chosen in combinations(range(blocks), blocks - distance)]


def block_keys(hash_: Column, source: Column, n: Column, distance: int) -> Column:
    """Keys of a hash in a source of ``n`` different titles. The larger the source, the more bits a key has (15, 20 or 24 at a distance of six), so that a key is shared by few."""
    plan = [F.transform(F.array(*map(F.lit, block_masks(distance, distance + k))), lambda m: F.xxhash64(source, m, hash_.bitwiseAND(m))) for k in (2, 3, 4)]
    return F.when(n < 1 << 13, plan[0]).when(n < 1 << 18, plan[1]).otherwise(plan[2])


def richest(df: DataFrame, key: Column, id_col: str, has_date: Column) -> DataFrame:
    """(key, id) of the richest copy of each key: longest content, longest summary, dated, least id. Null and empty keys are left out.

    One aggregate with a partial step, so a key of a third of all rows is no burden.
    """
    rank = F.struct(_size("content").alias("c"), _size("summary").alias("s"), has_date.cast("int").alias("d"), (-F.col(id_col)).alias("i"))
    out = df.withColumn("key", key).where("key is not null and key <> ''").groupBy("key").agg(F.max(rank).alias("best"), F.count("*").alias("n_copies"))
    return out.select("key", (-F.col("best.i")).alias("id"), "n_copies")


def near_classes(df: DataFrame, id_col: str, source: str, title: str, more: str | None = None, distance: int = 6, contained: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(members: id, class; links: x, y): articles of one source with the same words in order, and the classes that are near.

    Near are classes whose SimHash (of ``title`` and ``more``) is within
    ``distance`` bits, or of whose titles one contains the other to ``contained``.
    Candidates share a key of the hash (:func:`block_keys`) or, for containment,
    one of the least frequent words that must be shared; they are verified in the
    join that finds them. Titles without tokens and null sources are in neither
    table.
    """
    words = X.tokens(F.col(title))
    both = X.tokens(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(more, F.lit("")))) if more else words
    toks = df.select(F.col(id_col).alias("id"), F.col(source).alias("source"), F.array_sort(F.array_distinct(words)).alias("set"), both.alias("list"))
    toks = toks.where((F.size("set") > 0) & F.col("source").isNotNull())
    toks = cut(toks.select("id", "source", "set", X.simhash(F.col("list"), BITS).alias("hash"), F.xxhash64("source", "list", "set").alias("class")))
    heads = toks.groupBy("class").agg(F.first("source").alias("source"), F.first("set").alias("set"), F.first("hash").alias("hash"))
    sizes = heads.groupBy("source").agg(F.count("*").alias("of"))
    keyed = heads.join(sizes, "source").select("class", "hash", F.explode(block_keys(F.col("hash"), F.col("source"), F.col("of"), distance)).alias("k"))
    far = X.hamming(F.col("hx"), F.col("hy")) <= distance
    by_bits = keyed.toDF("x", "hx", "k").join(keyed.toDF("y", "hy", "k"), "k").where((F.col("x") < F.col("y")) & far).select("x", "y")
    word = heads.select("class", "source", F.size("set").alias("n"), F.explode("set").alias("w"))
    often = word.groupBy("source", "w").agg(F.count("*").alias("df"))
    ranked = word.join(often, ["source", "w"]).groupBy("class", "source", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "w"))), lambda x: x["w"]).alias("r"))
    # the smaller set has ceil(0.9 n) words in the other one, so one of its first n - ceil(0.9 n) + 1 is shared; the other set is asked with all its words
    need = F.ceil(F.col("n") * contained - 1e-9)
    few = ranked.select(F.col("class").alias("p"), "source", F.col("n").alias("np"), F.explode(F.slice("r", 1, (F.col("n") - need + 1).cast("int"))).alias("w"))
    met = few.join(word.select(F.col("class").alias("q"), "source", F.col("n").alias("nq"), "w"), ["source", "w"]).where((F.col("p") != F.col("q")) & (F.col("np") <= F.col("nq")))
    cand = met.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct()
    side = lambda p, k: heads.select(F.col("class").alias(k), F.col("set").alias(f"{p}s"))
    by_word = cand.join(side("a", "x"), "x").join(side("b", "y"), "y").where(X.containment(F.col("as"), F.col("bs")) >= contained).select("x", "y")
    return toks.select("id", "class"), by_bits.union(by_word).distinct()


def near_pairs(df: DataFrame, id_col: str, source: str, title: str, more: str | None = None, distance: int = 6, contained: float = 0.9) -> DataFrame:
    """(a, b), a < b: the articles of :func:`near_classes`, spelled out in pairs."""
    m, good = near_classes(df, id_col, source, title, more, distance, contained)
    across = good.join(m.select(F.col("class").alias("x"), F.col("id").alias("i")), "x").join(m.select(F.col("class").alias("y"), F.col("id").alias("j")), "y").select("i", "j")
    within = m.join(m.select("class", F.col("id").alias("j")), "class").where("id < j").select(F.col("id").alias("i"), "j")
    return across.union(within).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))


def near_links(df: DataFrame, id_col: str, source: str, title: str, more: str | None = None) -> DataFrame:
    """One row an article with a title: id, class_id (least id with the same words), n_copies of its class, n_links to other classes."""
    m, good = near_classes(df, id_col, source, title, more)
    heads = m.groupBy("class").agg(F.min("id").alias("class_id"), F.count("*").alias("n_copies"))
    degree = good.select(F.col("x").alias("class")).union(good.select("y")).groupBy("class").agg(F.count("*").alias("n_links"))
    return m.join(heads, "class").join(degree, "class", "left").select("id", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def exact_kept(df: DataFrame, id_col: str = "id") -> DataFrame:
    """(kept_id, first_id, n_copies): articles that share an address (canonical_url, else url) or a content hash, also by way of others, are one; the richest is kept, in the place of the first seen (least id).

    Richest is the longest content, then the longest summary, then one with a
    date, then the least id. Articles and their keys are a graph whose components
    are the groups, so no group is gathered.
    """
    text = lambda c: F.when(F.trim(c) != "", F.col(c))
    keys = {"u": F.coalesce(text("canonical_url"), text("url")), "h": text("content_hash")}
    slim = cut(df.select(F.col(id_col).alias("id"), *[F.when(v.isNotNull(), F.concat(F.lit(k), v)).alias(k) for k, v in keys.items()], _size("content").alias("c"), _size("summary").alias("s"), (F.coalesce(F.col("published_at").cast("string"), F.lit("")) != "").cast("int").alias("d")))
    ends = slim.select("id", F.explode(F.array_compact(F.array("u", "h"))).alias("key"))
    edges = ends.join(ends.groupBy("key").agg(F.min("id").alias("least")), "key").select(F.col("id").alias("src"), F.col("least").alias("dst"))
    label = components(edges).withColumnRenamed("node", "id")
    rank = F.struct("c", "s", "d", (-F.col("id")).alias("i"))
    out = slim.join(label, "id", "left").groupBy(F.coalesce("component", "id").alias("group")).agg(F.max(rank).alias("best"), F.min("id").alias("first_id"), F.count("*").alias("n_copies"))
    return out.select((-F.col("best.i")).alias("kept_id"), "first_id", "n_copies")


def _size(c: str) -> Column:
    return F.length(F.coalesce(F.col(c), F.lit("")))


def first_kept(ids: DataFrame, pairs: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(id, kept_id): rows taken in the order of their ids, each kept unless it pairs with a kept earlier one, whose id it then has (the least).

    Same result as the sequential pass. In a round every row decides whose
    earlier partners have all decided; the number of rounds is the longest chain
    of waiting, which is short in practice. Only undecided pairs go on.
    """
    edges = cut(pairs.where("a < b").select(F.col("a").alias("early"), F.col("b").alias("late")).distinct())
    done = None
    for _ in range(most_rounds):
        waiting = edges.select(F.col("late").alias("id")).distinct()
        free = edges.select(F.col("early").alias("id")).distinct().join(waiting, "id", "left_anti")
        taken = cut(edges.join(free.select(F.col("id").alias("early")), "early", "left_semi").groupBy("late").agg(F.min("early").alias("kept_id")))
        part = taken.select(F.col("late").alias("id"), "kept_id")
        done = part if done is None else done.union(part)
        gone = taken.select(F.col("late"))
        edges = cut(
            edges.join(gone, "late", "left_anti")
            .join(gone.withColumnRenamed("late", "early"), "early", "left_anti")
            .join(free.select(F.col("id").alias("early")), "early", "left_anti")
            .select("early", "late")
        )
        if edges.isEmpty():
            break
    else:
        raise RuntimeError("first_kept did not settle")
    return ids.join(done, "id", "left").select("id", F.coalesce("kept_id", "id").alias("kept_id"))
