"""Texts cut off by field limits or broken transfers.

A stack automaton runs over a text and reports what is still open at its end:
quotes, brackets, markup, a broken entity or escape, a lost half of a character.
A text that ends with an omission mark is cut, and so is one whose last paragraph
leaves a quote, bracket or tag open, even after a terminator. One that ends with a
terminator and nothing broken or open is complete. For the rest, the words at the end decide: a
model learned from the ends of complete sentences and lines, and from random
cuts of the same lines, tells how likely a text may stop there; lengths at which
the unterminated texts of a source pile up (its field limits) add to that, and so
does how often the source leaves terminators out, against all sources.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.entities import name2codepoint

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.schemas import fields
from pressloom.session import spool

PAIRS = {"”": "“„", "“": "„", "»": "«", ")": "(", "]": "[", ">": "<"}
OPENERS = "“„«([<"
SIGNS = re.compile(r"[“”„«»()\[\]<>\"]")
OMISSION = re.compile(r"(?:…|\.\.\.|\. \. \.|\[\s*(?:…|\.\.\.|more|mehr|suite)\s*\]|\((?:more|…|\.\.\.)\)|(?:…|\.\.\.)\s*[\])»”\"]?)\s*$", re.I)
BROKEN = re.compile(r"(?:&#x?[0-9a-fA-F]*|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|\\|%[0-9A-F]{2}\S*%[0-9A-F]?|<[a-zA-Z/!][^<>]*|[�\ud800-\udbff])$")
REFERENCE = re.compile(r"&([a-zA-Z]{2,8})$")
BEGUN = frozenset(name[:n] for name in name2codepoint for n in range(2, len(name) + 1))
TERMINATED = re.compile(r"[.!?。！？]['’\"”“»)\]\s]*$")
SHORT_FORM = re.compile(r"(?:^|[\s(“\"«„-])(?:[^\W\d_]|dr|mr|mrs|ms|prof|st|no|nr|vs|sr|jr)\.\s*$", re.I)
CREDIT = re.compile(r"[.!?。][\"”»)]*\s+(?:\([^()]{2,40}\)|[—–-]\s*[^\W\d_][^.!?]{1,40})$")
LABEL = re.compile(r"^[^\W\d_]+(?: [^\W\d_]+){0,2}: ")
ADDRESS = re.compile(r"(?:https?://|www\.)\S+$", re.I)
TOKEN = re.compile(r"[^\W_]+|[^\w\s]")
BOUNDARY = re.compile(r"(?<=[.!?])[\"”»)]*\s+")
DIM = 1 << 18


def last_line(text: str) -> str:
    """The last line that isn't blank."""
    return text.rstrip().rpartition("\n")[2].strip()


def left_open(line: str) -> str:
    """What the automaton has on its stack at the end of a line; lines close what they open."""
    stack: list[str] = []
    for c in SIGNS.findall(line):
        if c == '"':
            if '"' in stack:
                del stack[stack.index('"') :]
            else:
                stack.append(c)
        elif stack and stack[-1] in PAIRS.get(c, ""):
            stack.pop()
        elif c in OPENERS:
            stack.append(c)
    return "".join(stack)


def broken(body: str) -> bool:
    """Whether a text ends inside an entity, escape, tag or character. ``&`` and letters count only where they begin a known reference (not ``R&D``), ``%`` only after another escape."""
    return bool(BROKEN.search(body)) or bool((m := REFERENCE.search(body)) and m[1] in BEGUN)


def last_sentence(line: str) -> str:
    """What follows the last sentence end inside a line, sought from the end in growing steps."""
    span = 400
    while True:
        parts = BOUNDARY.split(line[-span:])
        if len(parts) > 1 or span >= len(line):
            return parts[-1]
        span *= 4


NO_OPENER = re.compile(r"(?<=[^\W_]|[.!?,…])[“„«]|(?<=\d)\"|<(?![a-zA-Z/!])|(?<!\w)[:;=]-?[(\[<]")


def unclosed(line: str) -> str:
    """What the last paragraph of a text leaves open at its end.

    Signs that open nothing don't count: quotes right after a letter, digit or
    stop (garbled letters, closing « and inches), a 'less than', a face. They
    still close what is open, as “ does after „.
    """

    def kept(m: re.Match) -> str:
        before = line[: m.start()]
        closes = m[0] == "“" and "„" in before or m[0] == '"' and before.count('"') % 2
        return m[0] if closes else " "

    return left_open(NO_OPENER.sub(kept, line))


@dataclass
class EndModel:
    """Weights of hashed features of the last words: positive where a text may stop."""

    vocabulary: frozenset = frozenset()
    weights: np.ndarray = field(default_factory=lambda: np.zeros(DIM, np.float32))

    def features(self, line: str) -> list[int]:
        """Hashed features of the end of a line, its closing terminator left off."""
        sentence = last_sentence(line)
        raw = TOKEN.findall(sentence)
        tokens = []
        for w in raw[-8:]:
            low = w.lower()
            if w[0].isdigit():
                tokens.append("0")
            elif low in self.vocabulary or not w[0].isalnum():
                tokens.append(low)
            else:
                tokens.append("C" if w[0].isupper() else "U")
        t = ["<"] * (8 - len(tokens)) + tokens
        names = [
            f"1{t[-1]}", f"2{t[-2]}", f"3{t[-3]}", f"12{t[-2]} {t[-1]}", f"23{t[-3]} {t[-2]}", f"34{t[-4]} {t[-3]}", f"45{t[-5]} {t[-4]}",
            f"56{t[-6]} {t[-5]}", f"123{t[-3]} {t[-2]} {t[-1]}", f"234{t[-4]} {t[-3]} {t[-2]}", f"345{t[-5]} {t[-4]} {t[-3]}", f"13{t[-3]} {t[-1]}",
            f"n{min(len(raw), 20)}", f"open{left_open(sentence)}", f"456{t[-6]} {t[-5]} {t[-4]}", f"1234{t[-4]} {t[-3]} {t[-2]} {t[-1]}", "all",
        ]
        return [xxhash.xxh3_64_intdigest(x) % DIM for x in names]

    def score(self, line: str) -> float:
        """Log-odds that a text may stop at the end of ``line``."""
        return float(self.weights[self.features(line)].sum())


def learn_ends(texts: list[str], titles: list[str], seed: int = 7, rounds: int = 10) -> EndModel:
    """Fit the model to texts and titles.

    Good ends are those of titles, of sentences with a terminator, and of lines
    that another follows. The end of a whole text is one only with a terminator,
    or when three texts of the sample have its last line (numbers and capitals
    aside): it may be cut. Random cuts of the same sentences are bad ends.
    """
    rng = np.random.default_rng(seed)
    lines = [[x.strip() for x in t.split("\n") if x.strip()] for t in texts]
    plain = lambda x: re.sub(r"\d+", "0", " ".join(x.lower().split()))
    last = Counter(plain(x[-1]) for x in lines if x)
    counts = Counter(w.lower() for x in lines for line in x for w in TOKEN.findall(line) if w.isalpha())
    model = EndModel(frozenset(w for w, n in counts.items() if n >= 5))
    rows, labels = [], []

    def add(line: str, good: bool) -> None:
        line = re.sub(r"[.!?…]+([\"”»)]*)\s*$", r"\1", line) if good else line.rstrip()
        if len(line) > 2:
            rows.append(model.features(line))
            labels.append(good)

    def learn(part: str, good: bool) -> None:
        if good:
            add(part, True)
        if len(part) > 12:
            for cut in rng.integers(4, len(part) - 2, size=2):
                add(part[:cut], False)
            if (space := part.rfind(" ", 0, int(cut))) > 3:
                add(part[:space], False)

    for title in titles:
        learn(title.strip(), True)
    for x in lines:
        for i, line in enumerate(x):
            parts = BOUNDARY.split(line)
            for j, part in enumerate(parts):
                end = i == len(x) - 1 and j == len(parts) - 1
                learn(part, not end or bool(TERMINATED.search(part)) and not OMISSION.search(part) or last[plain(line)] >= 3)
    if not rows:
        return model
    x, y = np.array(rows, dtype=np.int64), np.array(labels, dtype=np.float32)
    w, g2 = model.weights, np.full(DIM, 1e-6, np.float32)
    for _ in range(rounds):
        for batch in np.array_split(rng.permutation(len(y)), max(1, len(y) // 512)):
            p = 1 / (1 + np.exp(-w[x[batch]].sum(axis=1)))
            g = np.repeat((p - y[batch])[:, None], x.shape[1], 1).reshape(-1)
            at = x[batch].reshape(-1)
            step = np.zeros(DIM, np.float32)
            np.add.at(step, at, g)
            hit = np.unique(at)
            g2[hit] += step[hit] ** 2
            w[hit] -= 0.3 * step[hit] / np.sqrt(g2[hit]) + 1e-4 * w[hit]
    return model


JUDGED = fields("id long, source_id string, field_name string, chars int, bytes int, state string, score double")


def judge(df: DataFrame, model: EndModel) -> DataFrame:
    """(id, source_id, field_name, chars, bytes, state, score) of each non-blank text of (id, source_id, title, field_name, text)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out: list[tuple] = []
            for i, source, title, name, text in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if not text or not (body := text.strip()):
                    continue
                line = last_line(body)
                state, score = "complete", 9.0
                if OMISSION.search(line):
                    state, score = "marked", -9.0
                elif broken(body):
                    state, score = "broken", -9.0
                elif body == (title or "").strip() or ADDRESS.search(line) or CREDIT.search(line):
                    pass
                elif unclosed(line):
                    state, score = "unclosed", -9.0
                elif not TERMINATED.search(line) or SHORT_FORM.search(line):
                    state, score = "open", m.score(line) + (2.5 if LABEL.match(line) else 0.0)
                out.append((i, source, name, len(text), len(text.encode("utf-8", "replace")), state, score))
            cols = list(zip(*out)) if out else [[] for _ in JUDGED.names]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=JUDGED.names)

    return df.select("id", "source_id", "title", "field_name", "text").mapInArrow(run, JUDGED)


def sample(texts: DataFrame, most: int, chars: int = 20000) -> list[str]:
    """At most ``most`` texts of at most ``chars`` characters (so the driver holds a bounded sample), those of least hash: a bounded sample that doesn't depend on the order of rows."""
    fit = texts.where(F.length("text").between(1, chars)).withColumn("mark", F.xxhash64("id", "field_name"))
    share = min(1.0, 1.5 * most / max(1, fit.count()) + 1e-6)  # first cut by hash, so that no task sends more than its part
    low = min(-(1 << 63) + int(share * (1 << 64)), (1 << 63) - 1)
    rows = fit.where(F.col("mark") <= low).orderBy("mark", "id").limit(most).select("text").collect()
    return [r["text"] for r in rows]


def fields_of(articles: DataFrame) -> DataFrame:
    """(id, source_id, title, field_name, text) for summary and content of each article."""
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in ("summary", "content")]))
    return articles.select("id", "source_id", "title", pair.alias("f")).select("id", "source_id", "title", "f.field_name", "f.text")


def truncated(articles: DataFrame, training_texts: int = 8000, pile_share: float = 0.08, pile_least: int = 5, threshold: float = 0.0, most_shift: float = 0.4) -> DataFrame:
    """(article_id, source_id, field_name, is_cut, reason) of every non-blank summary and content.

    ``training_texts`` bounds the sample the model of ends is fitted to. A length
    in characters or bytes is a field limit of a source when at least ``pile_least`` and ``pile_share``
    of its unterminated texts of that field have it; such texts need less
    evidence from their last words. Sources that leave terminators out more often
    than the field does over all sources need more, others less, by the logarithm
    of the ratio of the two rates, at most ``most_shift``: a baseline counted over
    all rows, with one text of either kind added. Null and blank texts have no row. A null
    source_id is a source of its own. Ids must be unique.
    """
    rows = fields_of(articles)
    titles = articles.select("id", F.lit("title").alias("field_name"), F.col("title").alias("text"))
    model = learn_ends(sample(rows.select("id", "field_name", "text"), training_texts), sample(titles, training_texts // 6))
    found = spool(judge(rows, model), "ends")
    open_ = found.where("state = 'open'")
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("unit"), F.col(c).alias("length")) for c in ("chars", "bytes")]))
    by_length = open_.select("source_id", "field_name", both.alias("u")).groupBy("source_id", "field_name", "u.unit", "u.length").agg(F.count("*").alias("n"))
    by_field = open_.groupBy("source_id", "field_name").agg(F.count("*").alias("total"))
    keys = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("source_id", "field_name")]
    piles = (
        by_length.alias("l").join(by_field.alias("r"), keys[0] & keys[1])
        .where((F.col("n") >= pile_least) & (F.col("n") >= F.col("total") * pile_share))
        .groupBy(F.col("l.source_id").alias("p_source"), F.col("l.field_name").alias("p_field"))
        .agg(*[F.collect_set(F.when(F.col("unit") == c, F.col("length"))).alias(f"p_{c}") for c in ("chars", "bytes")])  # at most 1 / pile_share each
    )
    at = F.col("source_id").eqNullSafe(F.col("p_source")) & (F.col("field_name") == F.col("p_field"))
    kinds = [F.count_if(F.col("state") == "open").alias("n_open"), F.count_if(F.col("state") == "complete").alias("n_complete")]
    per_source = found.groupBy("source_id", "field_name").agg(*kinds)
    whole = per_source.groupBy(F.col("field_name").alias("w_field")).agg(F.sum("n_open").alias("w_open"), F.sum("n_complete").alias("w_complete"))  # one row a field
    rate = lambda a, b: (F.col(a) + 1) / (F.col(a) + F.col(b) + 2)
    shift = F.log(rate("n_open", "n_complete") / rate("w_open", "w_complete"))
    base = per_source.join(F.broadcast(whole), F.col("field_name") == F.col("w_field")).select(
        F.col("source_id").alias("b_source"), F.col("field_name").alias("b_field"), F.greatest(F.lit(-most_shift), F.least(F.lit(most_shift), shift)).alias("shift")
    )
    piled = F.array_contains("p_chars", F.col("chars")) | F.array_contains("p_bytes", F.col("bytes"))
    of = F.col("source_id").eqNullSafe(F.col("b_source")) & (F.col("field_name") == F.col("b_field"))
    out = found.join(piles, at, "left").join(base, of, "left").withColumn("at_limit", F.coalesce(piled, F.lit(False)))
    odds = F.col("score") + F.coalesce("shift", F.lit(0.0)) - F.when(F.col("at_limit"), math.log(30)).otherwise(0.0)
    cut = F.col("state").isin("marked", "broken", "unclosed") | ((F.col("state") == "open") & (odds < threshold))
    reason = F.when(~cut, F.lit(None)).when(F.col("state") != "open", F.col("state")).when(F.col("at_limit"), "field_limit").otherwise("open_end")
    return out.select(F.col("id").alias("article_id"), "source_id", "field_name", cut.alias("is_cut"), reason.alias("reason"))


def rates(cuts: DataFrame) -> DataFrame:
    """How often each source cuts each field: texts, cut texts, rate."""
    n, k = F.count("*"), F.count_if("is_cut")
    return cuts.groupBy("source_id", "field_name").agg(n.alias("n_texts"), k.alias("n_cut"), F.round(k / n, 6).alias("cut_rate"))
