"""Topics from an inspectable lexicon."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.functions import text as X

# Weights and thresholds of the scores.
PHRASE, LEAST, BAND, GENERIC_FACTOR, SPECIFIC = 1.6, 1.5, 0.45, 0.45, 2.0
GENERIC = ("technology", "world", "business", "science")
# A small lexicon to start with; a deployment gives its own to load_lexicon.
DEFAULT = {
    "ai": "ai,machine learning,neural network,chatbot,language model",
    "linux": "linux,kernel,distro,systemd,wayland",
    "open-source": "open source,maintainers,maintainer,github,compiler",
    "hardware": "chip,gpu,cpu,sensor,battery,router",
    "technology": "software,app,cloud,startup,module,project,version",
    "security": "security,breach,malware,ransomware,encryption",
    "science": "research,study,laboratory,experiment,samples",
    "space": "space,rocket,satellite,orbit,launch,planetarium",
    "business": "company,revenue,shares,profit,sales,bids,quarter",
    "markets": "market,inflation,tariff,stocks,subsidy,pension",
    "us-politics": "congress,senate,election,white house,vote,mayor",
    "geopolitics": "sanctions,treaty,ceasefire,summit,foreign policy",
    "world": "government,minister,protest,crisis,court,council",
    "climate": "climate,emissions,solar,wetland,reservoir",
    "health": "health,hospital,clinic,vaccine,disease",
    "culture": "museum,theatre,film,music,festival,library,playhouse",
    "sports": "sport,football,tournament,league,stadium",
}


def lexicon(table: dict[str, str] | None = None) -> dict[str, list[str]]:
    return {t: [w.strip() for w in ws.split(",") if w.strip()] for t, ws in (table or DEFAULT).items()}


def load_lexicon(path: str) -> dict[str, list[str]]:
    """A lexicon from a JSON file: topic -> list of words and phrases."""
    return json.loads(Path(path).read_text())


def topic_scores(folded: Column, words: Column, lex: dict[str, list[str]]) -> Column:
    """Map topic -> score of a folded text and its tokens (stopwords kept): one a distinct word, 1.6 a phrase; topics without a hit are absent.

    Both should be columns and not expressions: every topic looks at them.
    """

    def entry(topic: str, terms: list[str]) -> Column:
        single = [t for t in terms if " " not in t and "." not in t]
        hits = F.size(F.array_intersect(words, F.array(*map(F.lit, single)))).cast("double") if single else F.lit(0.0)
        found = [F.when(X.contains_term(folded, t), PHRASE).otherwise(0.0) for t in terms if t not in single]
        return F.struct(F.lit(topic).alias("key"), reduce(lambda a, b: a + b, found, hits).alias("value"))

    return F.map_from_entries(F.filter(F.array(*[entry(t, ws) for t, ws in lex.items()]), lambda e: e["value"] > 0))


def classify(scores: Column, most: int = 3) -> Column:
    """Topics of a score map, best first: generic ones count less beside a specific one; below 1.5 the topic is ``general``; those within 0.45 of the best stay."""
    rows = F.map_entries(scores)
    generic = lambda t: t.isin(*GENERIC)
    specific = F.exists(rows, lambda e: ~generic(e["key"]) & (e["value"] >= SPECIFIC))
    value = lambda e: F.when(generic(e["key"]) & specific, e["value"] * GENERIC_FACTOR).otherwise(e["value"])
    ranked = F.array_sort(F.transform(rows, lambda e: F.struct((-value(e)).alias("v"), e["key"].alias("t"))))
    best = F.coalesce(-F.get(ranked, F.lit(0))["v"], F.lit(0.0))
    kept = F.filter(F.slice(ranked, 1, most), lambda r: -r["v"] >= F.greatest(F.lit(LEAST), best * BAND))
    return F.when(best < LEAST, F.array(F.lit("general"))).otherwise(F.transform(kept, lambda r: r["t"]))


def article_text(title: str = "title", summary: str = "summary", content: str = "content") -> Column:
    """The text that topics are scored on: all of it but what lies beyond 2,000 characters of content."""
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.concat(part(title), F.lit(". "), part(summary), F.lit(" "), F.substring(part(content), 1, 2000))


def scored(df: DataFrame, lex: dict[str, list[str]] | None = None) -> DataFrame:
    """``df`` with ``topic_scores``; the text is folded and cut into words once, for all topics."""
    lex = lex or lexicon()
    every = sorted({t for ws in lex.values() for t in ws if " " not in t and "." not in t})
    df = df.withColumn("_text", article_text()).withColumns({"_folded": F.coalesce(X.fold(F.col("_text")), F.lit("")), "_words": F.filter(X.tokens(F.col("_text"), drop_stopwords=False), lambda w: w.isin(every))})
    return df.withColumn("topic_scores", topic_scores(F.col("_folded"), F.col("_words"), lex)).drop("_text", "_folded", "_words")


# What a category adds to the topic it names, and how much the words in it count.
OF_ITEM, OF_SOURCE = (1.4, 0.35), (0.55, 0.12)


def _hints(categories: Column, weights: tuple[float, float], lex: dict[str, list[str]]) -> list[Column]:
    """For each topic what the categories of an item or a source add to its score."""
    direct, words = weights
    folded = F.transform(F.coalesce(categories, F.array().cast("array<string>")), lambda c: F.trim(X.fold(c)))

    def of(topic: str, terms: list[str]) -> Column:
        single, phrases = [t for t in terms if " " not in t and "." not in t], [t for t in terms if " " in t or "." in t]

        def one(c: Column) -> Column:
            hits = F.size(F.array_intersect(X.tokens(c, drop_stopwords=False), F.array(*map(F.lit, single)))).cast("double") if single else F.lit(0.0)
            hits = reduce(lambda a, t: a + F.when(X.contains_term(c, t), PHRASE).otherwise(0.0), phrases, hits)
            return F.when(F.replace(c, F.lit(" "), F.lit("-")) == topic, direct).otherwise(0.0) + words * hits

        return F.aggregate(folded, F.lit(0.0), lambda a, c: a + one(c))

    return [of(t, ws) for t, ws in lex.items()]


def hinted(scores: Column, item: Column, source: Column, lex: dict[str, list[str]]) -> Column:
    """A score map with the hints of the item's categories and of its source's. Those of a source are too weak to give a topic alone."""
    rows = [
        F.struct(F.lit(t).alias("key"), (F.coalesce(F.try_element_at(scores, F.lit(t)), F.lit(0.0)) + a + b).alias("value"))
        for t, a, b in zip(lex, _hints(item, OF_ITEM, lex), _hints(source, OF_SOURCE, lex))
    ]
    return F.map_from_entries(F.filter(F.array(*rows), lambda e: e["value"] > 0))


def with_topics(df: DataFrame, lex: dict[str, list[str]] | None = None, hints: bool = False) -> DataFrame:
    """``df`` with ``topic_scores`` and ``topics``; with ``hints`` the columns feed_categories and source_categories (arrays, may be null) count too."""
    out = scored(df, lex)
    if hints:
        out = out.withColumn("topic_scores", hinted(F.col("topic_scores"), F.col("feed_categories"), F.col("source_categories"), lex or lexicon()))
    return out.withColumn("topics", classify(F.col("topic_scores")))
