"""Text functions as Column expressions: they stay in the JVM and inside whole-stage code generation where Spark allows."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# English function words and newswire filler.
STOPWORDS = """
a about above after again against all am an and any are aren't as at be because been before being below between both but by
can cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't
have haven't having he her here hers herself him himself his how i if in into is isn't it its itself just me more most my
myself no nor not of off on once only or other ought our ours ourselves out over own same shan't she should shouldn't so some
such than that the their theirs them themselves then there these they this those through to too under until up very was
wasn't we were weren't what when where which while who whom why will with won't would wouldn't you your yours yourself
yourselves said says say told according reported report reports news update latest via
""".split()
# Words that carry the intent of a question and not its subject.
QUERY_NOISE = """
what whats happening happened happens tell show give find get latest news story stories article articles today todays
yesterday week weeks month recent recently current currently going on around biggest bigger big top main major important key
please me my i want know about anything something new update updates briefing brief summary summarise summarize headline headlines
""".split()

TOKEN = "[a-z0-9][a-z0-9'’+.#-]*"
EDGES = "'’.-"


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Letters whose decomposition is one base letter and combining marks, and those base letters."""
    pairs = {}
    for code in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]:
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
        if len(base) == 1 and base != c and c.isalpha():
            pairs[c] = base
    return "".join(pairs), "".join(pairs.values())


def fold(text: Column) -> Column:
    """Lower case without accents. Null stays null."""
    old, new = _accents()
    return F.regexp_replace(F.translate(F.lower(text), old, new), r"\p{M}+", "")


def whitespace(text: Column) -> Column:
    """Runs of white space to one space, trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def _entities(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(html.unescape, na_action="ignore")


def strip_html(markup: Column) -> Column:
    """Readable text of an HTML fragment; null becomes empty. Character references are decoded in Arrow batches, the rest by regular expressions."""
    unescape = F.pandas_udf(_entities, T.StringType())
    text = F.coalesce(markup, F.lit(""))
    text = F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1>", " ")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>|</p>|</div>|</li>", "\n")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    text = F.when(F.contains(text, F.lit("&")), unescape(text)).otherwise(text)
    text = F.translate(text, " ", " ")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, r"\s*\n\s*", "\n")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tokens(text: Column, drop_stopwords: bool = True) -> Column:
    """Folded tokens of at least two characters, in order; null has none."""
    found = F.regexp_extract_all(F.coalesce(fold(text), F.lit("")), F.lit(f"({TOKEN})"), F.lit(1))
    found = F.transform(found, lambda x: F.regexp_replace(x, f"^[{EDGES}]+|[{EDGES}]+$", ""))
    if drop_stopwords:
        return F.filter(found, lambda x: (F.length(x) >= 2) & ~x.isin(STOPWORDS))
    return F.filter(found, lambda x: F.length(x) >= 2)


def sentences(text: Column, least: int = 25) -> Column:
    """Sentences of a text; one shorter than ``least`` characters joins the one before it. Null and blank have none."""
    parts = F.split(whitespace(text), r"(?<=[.!?])\s+(?=[\"'“(\[]?[A-Z0-9])")
    parts = F.filter(parts, lambda s: F.trim(s) != "")
    last = lambda a: F.element_at(a, -1)

    def add(done: Column, s: Column) -> Column:
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat_ws(" ", last(done), s)))
        return F.when((F.size(done) > 0) & (F.length(s) < least), joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(parts, F.array().cast("array<string>"), add)


def truncate(text: Column, limit: int, suffix: str = "…") -> Column:
    """At most ``limit`` characters, cut at the last space, with ``suffix`` when cut."""
    cut = F.substring(text, 1, limit)
    cut = F.when(F.contains(cut, F.lit(" ")), F.regexp_replace(cut, " [^ ]*$", "")).otherwise(cut)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(cut, "[ ,;:.-]+$", ""), F.lit(suffix)))


def contains_term(folded: Column, term: str) -> Column:
    """Whether a folded text has a word or phrase, also in its plural."""
    quoted = "\\Q" + term.replace("\\E", "") + "\\E"
    whole = folded.rlike(rf"(?<![a-z0-9]){quoted}(?:es|s)?(?![a-z0-9])")
    return F.coalesce(F.contains(folded, F.lit(term)) & whole, F.lit(False))  # the plain search is cheap and mostly fails


def entities(text: Column, most: int = 12) -> Column:
    """Acronyms (two points each) and runs of capitalised words that don't begin a sentence (one point), best first."""
    text = F.coalesce(text, F.lit(""))
    acronyms = F.filter(F.regexp_extract_all(text, F.lit(r"\b([A-Z][A-Za-z0-9]*(?:[A-Z][A-Za-z0-9]*)+)\b"), F.lit(1)), lambda x: F.length(x).between(2, 24))
    bodies = F.transform(sentences(text, 1), lambda s: F.when(F.contains(s, F.lit(" ")), F.regexp_replace(s, r"^[^ ]* ", "")).otherwise(""))
    proper = F.flatten(F.transform(bodies, lambda b: F.regexp_extract_all(b, F.lit(r"\b([A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,}){0,3})\b"), F.lit(1))))
    proper = F.filter(proper, lambda x: ~F.lower(x).isin(STOPWORDS))
    every = F.concat(acronyms, proper)
    count = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    ranked = F.transform(F.array_distinct(every), lambda x: F.struct((-2 * count(acronyms, x) - count(proper, x)).alias("w"), x.alias("t")))
    return F.slice(F.transform(F.array_sort(ranked), lambda r: r["t"]), 1, most)


def content_hash(*parts: Column) -> Column:
    """SHA-256 over the folded parts, each ended by the unit separator."""
    return F.sha2(F.concat(*[x for p in parts for x in (F.coalesce(fold(whitespace(p)), F.lit("")), F.lit("\x1f"))]), 256)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; 0 when either is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """Common part over the smaller set; 0 when either is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def _vote(bits: int):
    """Bit i is set when more than half of a row's codes have it."""

    def vote(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        place = np.arange(bits, dtype=np.int64)
        for rows in batches:
            sizes = np.array([0 if r is None else len(r) for r in rows], dtype=np.int64)
            some = np.flatnonzero(sizes)
            out = np.zeros(len(rows), np.int64)
            if len(some):
                flat = np.concatenate([rows.iloc[k] for k in some]).astype(np.int64)
                starts = np.cumsum(sizes[some]) - sizes[some]
                ones = np.add.reduceat((flat[:, None] >> place) & 1, starts, axis=0)
                out[some] = ((2 * ones > sizes[some][:, None]) << place).sum(axis=1)
            yield pd.Series(out, index=rows.index)

    return F.pandas_udf(vote, T.LongType())


def simhash(words: Column, bits: int = 60) -> Column:
    """SimHash of an array of tokens: bit i is set when more tokens have it than not, by the first ``bits`` bits of MD5. Empty and null give 0.

    The hashes are taken in the JVM; the votes, sixty a token, in Arrow batches.
    """
    codes = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, bits // 4), 16, 10).cast("long"))
    return _vote(bits)(codes)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two longs."""
    return F.bit_count(a.bitwiseXOR(b))


def recency(published: Column, now: Column, half_life_hours: float = 20.0) -> Column:
    """0.5 ** (age / half life); 0.35 without a time."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(published)) / 3.6e9)
    return F.coalesce(F.pow(F.lit(0.5), age / half_life_hours), F.lit(0.35))
