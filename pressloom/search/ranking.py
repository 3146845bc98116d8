"""BM25 over weighted columns, and the blend that ranks articles for a question.

The counts of a question's phrases come from a stored index
(:mod:`pressloom.search.index`), which is read by the buckets of its words, or,
for a table that is asked once, from one scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pressloom.functions import text as X
from pressloom.search.question import Question
from pressloom.search.terms import fold_text
from pressloom.session import cut, spool

# Column weights, BM25 constants, parts of the blend and gates.
WEIGHTS = {"title": 8.0, "summary": 3.0, "content": 1.0, "entities": 5.0, "topics": 4.0}
K1, B, FLOOR = 1.2, 0.75, 1e-6
CANDIDATES, LEAST_COVERAGE, RELATIVE, LEAST_SCORE = 120, 0.34, 0.5, 0.06


@dataclass(frozen=True)
class Phrase:
    """Consecutive index words; the last may be a prefix."""

    words: tuple[str, ...]
    prefix: bool = False


def index_words(text: Column) -> Column:
    """Words of the index: runs of letters and digits of the folded text, one-letter ones too."""
    return F.regexp_extract_all(F.coalesce(X.fold(text), F.lit("")), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def phrase(term: str) -> Phrase:
    """A term as the index sees it; plain words of four letters or more match as prefixes."""
    import re

    cleaned = " ".join(term.split())
    words = tuple(re.findall(r"[^\W_]+", fold_text(cleaned)))
    return Phrase(words, bool(re.fullmatch(r"[A-Za-z0-9_]+", cleaned)) and len(cleaned) >= 4 and len(words) == 1)


def phrases_of(q: Question, broad: bool = False) -> list[Phrase]:
    """Entities; keywords when there are none, or when the search is broad."""
    terms = q.entities or q.keywords
    if broad:
        terms = [*q.entities, *q.keywords]
    unique = {fold_text(t): t for t in reversed(terms) if len(fold_text(t)) >= 2}
    return [p for t in reversed(list(unique.values())) if (p := phrase(t)).words]


def occurrences(words: Column, p: Phrase) -> Column:
    """How often a phrase is in an array of index words."""
    last = len(p.words) - 1

    def at(i: Column) -> Column:
        hits = []
        for k, w in enumerate(p.words):
            here = F.get(words, i + k)
            hits.append(here.startswith(w) if p.prefix and k == last else here == w)
        return reduce(lambda a, b: a & b, hits)

    if last == 0:
        w = p.words[0]
        return F.size(F.filter(words, lambda x: x.startswith(w) if p.prefix else x == w))
    return F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), F.lit(0), lambda n, i: n + F.coalesce(at(i), F.lit(False)).cast("int"))


def match_table(df: DataFrame, phrases: list[Phrase], columns: dict[str, float], keep: list[str]) -> DataFrame:
    """(keep..., _len, _tf_0...): words of a row and weighted occurrences of each phrase, by one scan, stored: a few numbers a row."""
    wide = df.select(*keep, *[index_words(F.array_join(F.col(c), " ") if dict(df.dtypes)[c].startswith("array") else F.col(c)).alias(f"_w_{c}") for c in columns])
    tf = [reduce(lambda a, b: a + b, [occurrences(F.col(f"_w_{c}"), p) * w for c, w in columns.items()]).alias(f"_tf_{i}") for i, p in enumerate(phrases)]
    length = reduce(lambda a, b: a + b, [F.size(f"_w_{c}") for c in columns])
    return spool(wide.select(*keep, length.alias("_len"), *tf), "matches")


def bm25_of(table: DataFrame, which: list[int], keep: Column | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """``table`` with ``bm25`` over the phrases ``which``; only rows with one of them and ``keep``.

    The corpus figures are those of all rows: of ``table`` (:func:`match_table`), or
    of ``corpus`` (one row: _rows, _avg) where ``table`` holds matches only.
    """
    tf = [f"_tf_{i}" for i in which]
    seen = [F.count_if(F.col(t) > 0).alias(f"_n{t}") for t in tf]
    figures = table.agg(F.count("*").alias("_rows"), F.avg("_len").alias("_avg"), *seen) if corpus is None else table.agg(*seen).join(corpus)  # one row each
    wide = table.join(F.broadcast(figures))  # one row
    score = F.lit(0.0)
    for t in tf:
        raw = F.log((F.col("_rows") - F.col(f"_n{t}") + 0.5) / (F.col(f"_n{t}") + 0.5))
        idf = F.when(raw <= 0, FLOOR).otherwise(raw)
        score = score + idf * F.col(t) * (K1 + 1) / (F.col(t) + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    found = reduce(lambda a, b: a | b, [F.col(t) > 0 for t in tf])
    wide = wide.where(found & keep if keep is not None else found)
    return wide.withColumn("bm25", score).drop(*[f"_n{t}" for t in tf], "_rows", "_avg")


def bm25(df: DataFrame, phrases: list[Phrase], columns: dict[str, float], id_col: str = "id") -> DataFrame:
    """(id, bm25) of the rows with a phrase. Without phrases the result is empty; rows without words count to the number of rows."""
    if not phrases:
        return df.select(id_col).where(F.lit(False)).withColumn("bm25", F.lit(0.0))
    return bm25_of(match_table(df, phrases, columns, [id_col]), list(range(len(phrases)))).select(id_col, "bm25")


def term_coverage(q: Question) -> tuple[Column, Column, Column]:
    """(weighted share of the question's terms in an article, an entity is in it, a keyword is in it)."""
    empty = F.array().cast("array<string>")
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "summary")], F.substring(F.coalesce("content", F.lit("")), 1, 1500), F.array_join(F.coalesce("entities", empty), " "), F.array_join(F.coalesce("topics", empty), " "))
    hay, names = X.fold(text), {fold_text(e) for e in q.entities}
    total, hits, ent, key = 0.0, F.lit(0.0), F.lit(False), F.lit(False)
    for t in map(fold_text, q.terms):
        weight = 1.5 if t in names else 1.0
        total += weight
        has = X.contains_term(hay, t)
        hits = hits + F.when(has, weight).otherwise(0.0)
        ent, key = (ent | has, key) if t in names else (ent, key | has)
    return (hits / total if total else F.lit(0.0)), ent, key


def entity_score(q: Question) -> Column:
    if not q.entities:
        return F.lit(0.0)
    title, body = X.fold(F.coalesce("title", F.lit(""))), X.fold(F.when(F.coalesce("summary", F.lit("")) != "", F.col("summary")).otherwise(F.substring(F.coalesce("content", F.lit("")), 1, 800)))
    held = F.transform(F.coalesce("entities", F.array().cast("array<string>")), X.fold)
    hits = F.lit(0.0)
    for e in map(fold_text, q.entities):
        hits = hits + F.when(F.contains(title, F.lit(e)), 1.0).when(F.array_contains(held, e), 0.8).when(F.contains(body, F.lit(e)), 0.45).otherwise(0.0)
    return F.least(F.lit(1.0), hits / len(q.entities))


def topic_score(q: Question) -> Column:
    if not q.topics:
        return F.lit(0.0)
    topics, asked = F.coalesce("topics", F.array().cast("array<string>")), F.array(*map(F.lit, q.topics))
    n = F.size(F.array_intersect(topics, asked))
    lead = F.when(F.array_contains(asked, F.get(topics, F.lit(0))), 0.4).otherwise(0.0)
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), 0.6 * n / len(q.topics) + lead))


def blended(hits: DataFrame, q: Question, now: Column, time: Column, id_col: str, interest: Column | None = None) -> DataFrame:
    """Gates and blend over the at most :data:`CANDIDATES` rows of one search: ``score`` best first."""
    cover, ent, key = term_coverage(q)
    df = hits.withColumns({"coverage": cover, "_e": ent, "_k": key}).where(F.col("_e") | (F.col("coverage") >= LEAST_COVERAGE))
    facts = df.agg(F.max(F.col("_e") & F.col("_k")).alias("_both"), F.max(F.when(F.col("_k"), F.col("coverage"))).alias("_best_k"), F.max("coverage").alias("_best_all"))
    df = df.join(F.broadcast(facts)).where(~F.col("_both") | F.col("_k"))  # one row
    df = df.where(F.col("coverage") >= RELATIVE * F.when(F.col("_both"), F.col("_best_k")).otherwise(F.col("_best_all")))
    df = df.withColumns({"recency": X.recency(time, now), "entity": entity_score(q), "topic": topic_score(q), "interest": interest if interest is not None else F.lit(0.0)})
    score = 0.32 * F.col("lexical") + 0.22 * F.col("coverage") + 0.20 * F.col("entity") + 0.10 * F.col("topic") + 0.11 * F.col("recency") + 0.05 * F.col("interest")
    reasons = F.array_compact(F.array(F.when(F.col("entity") >= 0.5, "matches the entities in the query"), F.when(F.col("topic") >= 0.5, "matches the query topic"), F.when(F.col("recency") >= 0.5, "published recently")))
    return df.withColumns({"score": score, "reasons": reasons}).where(F.col("score") >= LEAST_SCORE).drop("_e", "_k", "_both", "_best_k", "_best_all").orderBy(F.desc("score"), F.desc("lexical"), id_col)


def retrieve(df: DataFrame, q: Question, now: Column, time: str, id_col: str = "id", widest: int = 1440, most: int = CANDIDATES, index=None, interest: Column | None = None) -> DataFrame:
    """The first of four searches with a result: names in the window, names at any time, all terms in the window, all terms at any time.

    With an ``index`` of ``df`` (:class:`~pressloom.search.index.SearchIndex`) only
    its buckets of the question's words are read; without, the articles are
    scanned once for all four searches. Each search works on the small table of
    matches and fetches its ``most`` best rows by id. ``interest`` is a column of
    ``df`` between 0 and 1 for the blend.
    """
    every, anchored = phrases_of(q, True), phrases_of(q)
    last = None
    if every:
        if index is None:
            table, corpus = match_table(df, every, {c: w for c, w in WEIGHTS.items() if c in df.columns}, [id_col, time]), None
        else:
            table, corpus = index.matches(every).withColumnsRenamed({"id": id_col, "_time": time}), cut(index.figures())
        for wanted in dict.fromkeys([tuple(every.index(p) for p in anchored), tuple(range(len(every)))]):
            for hours in dict.fromkeys([q.hours, max(q.hours, widest)]):
                keep = F.col(time) >= F.timestamp_micros(F.unix_micros(now) - int(hours * 3.6e9))
                top = cut(bm25_of(table, list(wanted), keep, corpus).select(id_col, "bm25").orderBy(F.desc("bm25"), id_col).limit(most))
                if top.isEmpty():
                    continue
                best = top.agg(F.max("bm25").alias("_max"))
                top = top.join(F.broadcast(best)).select(id_col, "bm25", F.least(F.lit(1.0), F.col("bm25") / F.col("_max")).alias("lexical"))  # one row
                hits = cut(df.join(F.broadcast(top), id_col))  # at most ``most`` rows; stored, else the gates are pushed below the join and asked of every row
                last = cut(blended(hits, q, now, F.col(time), id_col, interest))
                if not last.isEmpty():
                    return last
    return last if last is not None else df.where(F.lit(False)).withColumns({"score": F.lit(0.0), "lexical": F.lit(0.0), "reasons": F.array().cast("array<string>")})


def diversified(ranked: DataFrame, limit: int, id_col: str = "id") -> DataFrame:
    """Top ``limit`` in order with at most max(2, limit // 3) a source and two a cluster; the places left go to those passed over.

    The pass is sequential, over the bounded candidates of a question (at most
    :data:`CANDIDATES`), so it runs as one fold in one task.
    """
    per_source = max(2, limit // 3)
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(id_col).alias("id"), F.coalesce("source_id", F.lit("")).alias("src"), F.when(F.coalesce("cluster_id", F.lit("")) != "", F.col("cluster_id")).otherwise(F.concat(F.lit("solo:"), F.col(id_col).cast("string"))).alias("cl"))))
    empty = F.struct(F.array().cast("array<bigint>").alias("ids"), F.array().cast("array<string>").alias("src"), F.array().cast("array<string>").alias("cl"), F.array().cast("array<bigint>").alias("rest"))
    count = lambda a, x: F.size(F.filter(a, lambda y: y == x))

    def step(a: Column, r: Column) -> Column:
        full = F.size(a["ids"]) >= limit
        fits = (count(a["src"], r["src"]) < per_source) & (count(a["cl"], r["cl"]) < 2)
        return F.when(full, a).when(
            fits, F.struct(F.concat(a["ids"], F.array(r["id"].cast("long"))).alias("ids"), F.concat(a["src"], F.array(r["src"])).alias("src"), F.concat(a["cl"], F.array(r["cl"])).alias("cl"), a["rest"].alias("rest"))
        ).otherwise(F.struct(a["ids"].alias("ids"), a["src"].alias("src"), a["cl"].alias("cl"), F.concat(a["rest"], F.array(r["id"].cast("long"))).alias("rest")))

    out = ranked.agg(rows.alias("rows")).select(F.aggregate("rows", empty, step).alias("a"))
    return out.select(F.posexplode(F.slice(F.concat("a.ids", "a.rest"), 1, limit)).alias("place", id_col))
