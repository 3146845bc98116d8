"""Extractive summaries: sentences scored by how central their words are."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pressloom.functions import text as X
from pressloom.schemas import fields
from pressloom.search.terms import token_list


def best_text(content: str = "content", summary: str = "summary") -> Column:
    """The content when it is longer than the summary, else the summary."""
    c, s = F.coalesce(F.col(content), F.lit("")), F.coalesce(F.col(summary), F.lit(""))
    return F.when(F.length(c) > F.length(s), c).otherwise(s)


def scored_sentences(parts: list[str]) -> list[tuple[str, list[str], float]]:
    """(sentence, distinct words, score) of the sentences of one text.

    A sentence counts the inverse sentence frequency of its words times their
    number of sentences, over the root of its words; earlier ones and those of 8
    to 45 words count more.
    """
    tokens = [token_list(s) for s in parts]
    freq = Counter(w for t in tokens for w in set(t))
    weight = {w: math.log(1 + len(parts) / (1 + n)) * n for w, n in freq.items()}
    out = []
    for i, (s, t) in enumerate(zip(parts, tokens)):
        own = list(dict.fromkeys(t))
        central = math.fsum(weight[w] for w in own) / math.sqrt(len(own)) if own else 0.0
        out.append((s, own, central / (1 + 0.35 * i) * (1.0 if 8 <= len(t) <= 45 else 0.55 if len(t) < 8 else 0.8)))
    return out


SCORED = fields("id string, pos int, sentence string, words string[], score double")


def sentence_scores(texts: DataFrame, id_col: str, parts: Column) -> DataFrame:
    """(id, pos, sentence, words, score) of each sentence in the array ``parts`` of each row.

    The figures are those of one text, so a text is scored where it lies and
    nothing is shuffled.
    """
    kind = texts.select(id_col).schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, *x) for i, ps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, x in enumerate(scored_sentences(ps or []))]
            cols = list(zip(*rows)) if rows else [[] for _ in SCORED.names]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=SCORED.names)

    out = texts.select(F.col(id_col).cast("string").alias("id"), parts.alias("parts")).mapInArrow(run, SCORED)
    return out.withColumn("id", F.col("id").cast(kind))


def summaries(df: DataFrame, id_col: str, most: int = 2, limit: int = 400) -> DataFrame:
    """(id, brief) of each article: its best ``most`` sentences in their order; summary or title when it has none. No shuffle."""

    def best(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(pick)

    def pick(parts) -> str | None:
        rows = scored_sentences(list(parts)) if parts is not None else []
        chosen = sorted(sorted(range(len(rows)), key=lambda i: (-round(rows[i][2], 9), i))[:most])
        return " ".join(rows[i][0] for i in chosen) or None

    text = X.truncate(F.pandas_udf(best, T.StringType())(X.sentences(best_text())), limit)
    rest = X.truncate(F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.col("title"), F.lit("")), limit)
    return df.select(F.col(id_col).alias("id"), F.coalesce(text, rest).alias("brief"))


def group_summaries(df: DataFrame, group: str, id_col: str, most: int = 3, limit: int = 600, members: int = 6, per_member: int = 6, alike: float = 0.6) -> DataFrame:
    """(group, brief): the best sentences of a story's first articles, none that repeats another's words.

    At most ``members`` articles (least ids) and ``per_member`` sentences of each
    enter, cut inside a partial aggregation, so a story of any size gathers no
    more than their product.
    """
    heads = df.select(F.col(group).alias("id"), F.col(id_col).alias("m"), F.slice(X.sentences(best_text()), 1, per_member).alias("s")).where("id is not null")
    few = heads.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("m"))).where(F.col("k") <= members)  # group-limited before the shuffle
    pool = few.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"])).alias("pool"))
    rows = sentence_scores(pool, "id", F.col("pool"))
    ranked = rows.where(F.size("words") > 0).groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.round("score", 9)).alias("s"), "pos", "sentence", "words"))).alias("r"))
    start = F.array().cast("array<struct<t:string,w:array<string>>>")

    def step(a: Column, x: Column) -> Column:
        same = F.exists(a, lambda y: F.size(F.array_intersect(y["w"], x["words"])) / F.greatest(F.lit(1), F.least(F.size(y["w"]), F.size(x["words"]))) > alike)
        return F.when((F.size(a) >= most) | same, a).otherwise(F.concat(a, F.array(F.struct(x["sentence"].alias("t"), x["words"].alias("w")))))

    chosen = F.transform(F.aggregate("r", start, step), lambda y: y["t"])
    return ranked.select(F.col("id").alias(group), X.truncate(F.array_join(chosen, " "), limit).alias("brief"))
