"""Framing of articles, measured by inspectable word lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.functions import text as X

# Emotive or judging words.
LOADED = """
slam slammed slams blast blasted blasts bombshell shocking shocked stunning outrageous disgraceful scandal scandalous devastating
catastrophic disaster brutal savage destroy destroyed demolish eviscerate humiliating debacle desperate reckless dangerous
alarming chilling terrifying horrific unbelievable absurd ridiculous laughable insane crazy massive huge enormous unprecedented
historic radical extreme extremist fringe hardline far-left far-right so-called claims alleged allegedly purported apparent
supposedly crackdown chaos turmoil meltdown firestorm backlash fury outrage furious hoax witch-hunt smear plot conspiracy
elites establishment mainstream-media woke agenda narrative propaganda regime puppet
""".split()
# Marks of commentary.
OPINION = """
opinion editorial commentary analysis column columnist viewpoint perspective essay op-ed letter argues argue believe think
should must ought sadly frankly clearly obviously undoubtedly surely lets us we our my i
""".split()
# Vocabulary of either direction (parts of hyphened terms count alone).
LEFT = """
undocumented reproductive rights abortion rights gun violence gun safety climate crisis climate emergency systemic racism marginalised
marginalized equity inclusive lgbtq transgender rights healthcare access living wage corporate greed billionaires oligarch price gouging
union workers rights far right white nationalist insurrection disinformation misinformation voter suppression social justice progressive
""".split()
RIGHT = """
illegal aliens illegals amnesty pro life unborn second amendment gun rights climate alarmism radical left socialist marxist woke cancel
culture indoctrination groomer patriot law and order border crisis invasion big government overreach deep state censorship free speech
taxpayer funded job creators traditional values religious liberty election integrity mainstream media legacy media leftist
""".split()
LEFT_ACTORS = "democrat democrats democratic biden harris pelosi schumer aoc sanders labour progressive liberals leftwing".split()
RIGHT_ACTORS = "republican republicans gop trump desantis mcconnell johnson vance conservative tory tories rightwing maga".split()
# Attribution.
STRONG = r"(?i)\b(according to|said in a statement|told reporters|court filing|data (?:from|published)|the (?:report|study|filing|ruling) (?:said|found|shows)|in a (?:statement|filing|press release)|confirmed (?:to|that))\b"
WEAK = r"(?i)\b(sources say|sources said|people familiar|insiders? (?:say|said)|it is understood|reportedly|rumou?red|speculation|some say|critics say|observers say|many believe)\b"
OPINION_URL = r"(?i)/(opinion|opinions|editorial|editorials|commentary|comment|columns?|columnists?|analysis|voices|blogs?|perspectives?|viewpoint|op-ed|oped)(/|$)"
OPINION_TITLE = r"(?i)^\s*(opinion|editorial|commentary|analysis|column|op-ed|review|explainer)\s*[:|—-]"
POLITICAL_TOPICS = ("us-politics", "geopolitics", "world", "india", "europe", "asia")
LEAN_SCORE = {"left": -1.0, "center-left": -0.5, "center": 0.0, "center-right": 0.5, "right": 1.0}
CONFIDENCE_WEIGHT = {"low": 0.35, "medium": 0.65, "high": 1.0}
BUCKETS = ("left", "center-left", "center", "center-right", "right", "state-affiliated", "not-applicable", "unknown")


def _hits(words: Column, terms: list[str]) -> Column:
    return F.size(F.array_intersect(words, F.array(*[F.lit(t) for t in dict.fromkeys(terms)])))


def _of(column: Column, table: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def lean_of(score: Column) -> Column:
    """The name of a direction score."""
    return F.when(score <= -0.66, "left").when(score <= -0.2, "center-left").when(score < 0.2, "center").when(score < 0.66, "center-right").otherwise("right")


def is_political(lean: Column) -> Column:
    return lean.isin(*LEAN_SCORE)


def assess(df: DataFrame) -> DataFrame:
    """``df`` with the measures and ``lean``, ``lean_score``, ``confidence``, ``subjectivity``, ``is_opinion``, ``framing``.

    Needs title, summary, content, url, topics and, from the source, source_lean,
    source_confidence and source_type. Null texts count as empty, a source that
    isn't known as ``unknown`` with low confidence.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    body = F.when(F.length(text("content")) > F.length(text("summary")), text("content")).otherwise(text("summary"))
    blob = F.concat(text("title"), F.lit(". "), body)
    df = df.withColumn("_blob", blob).withColumns({"_words": X.tokens(F.col("_blob"), drop_stopwords=False), "_title": F.array_distinct(X.tokens(F.col("title"), drop_stopwords=False))})
    df = df.withColumns(
        {
            "n_tokens": F.greatest(F.lit(1), F.size("_words")),
            "n_loaded": _hits(F.col("_words"), LOADED),
            "n_opinion": _hits(F.col("_words"), OPINION),
            "n_strong": F.regexp_count("_blob", F.lit(STRONG)),
            "n_weak": F.regexp_count("_blob", F.lit(WEAK)),
            "n_left": _hits(F.col("_words"), LEFT),
            "n_right": _hits(F.col("_words"), RIGHT),
            "n_left_actors": _hits(F.col("_words"), LEFT_ACTORS),
            "n_right_actors": _hits(F.col("_words"), RIGHT_ACTORS),
            "_section": text("url").rlike(OPINION_URL) | text("title").rlike(OPINION_TITLE),
            "_prior": F.coalesce("source_lean", F.lit("unknown")),
        }
    )
    df = df.withColumns({"loaded_density": F.col("n_loaded") * 100 / F.col("n_tokens"), "is_opinion": F.col("_section") | (F.col("n_opinion") >= 4)})
    one = lambda x: F.least(F.lit(1.0), x)
    subjectivity = one(0.30 * one(F.col("loaded_density") / 2.0) + 0.30 * one(F.col("n_opinion") / 6.0) + F.when(F.col("is_opinion"), 0.30).otherwise(0.0) + 0.10 * one(F.col("n_weak") / 3.0))
    frames, actors = F.col("n_left") + F.col("n_right"), F.col("n_left_actors") + F.col("n_right_actors")
    imbalance = F.when(actors >= 3, F.abs(F.col("n_right_actors") - F.col("n_left_actors")) / actors).otherwise(0.0)
    frame = F.coalesce(F.try_divide(F.col("n_right") - F.col("n_left"), frames), F.lit(0.0))
    prior_known = is_political(F.col("_prior"))
    prior_weight = F.when(prior_known, _of(F.coalesce("source_confidence", F.lit("low")), CONFIDENCE_WEIGHT, 0.35) * 0.55).otherwise(0.0)
    evidence = F.least(F.lit(0.8), 0.25 * frames + 0.3 * imbalance)
    score = (_of(F.col("_prior"), LEAN_SCORE, 0.0) * prior_weight + frame * evidence) / F.greatest(F.lit(0.01), prior_weight + evidence)
    score = F.when((evidence <= 0.01) & (prior_weight <= 0.01), 0.0).otherwise(score)
    political = F.arrays_overlap(F.coalesce("topics", F.array().cast("array<string>")), F.array(*map(F.lit, POLITICAL_TOPICS))) | (actors > 0)
    strength = prior_weight + evidence
    confidence = F.when((strength >= 1.0) & (frames >= 2), "high").when(strength >= 0.5, "medium").otherwise("low")
    flags = F.array_compact(
        F.array(
            F.when(F.col("_section"), "opinion"),
            F.when(~F.col("_section") & (F.col("n_opinion") >= 4), "commentary-style"),
            F.when(F.col("source_type") == "vendor", "first-party"),
            F.when(F.col("source_type") == "aggregator", "aggregator"),
            F.when(F.col("_prior") == "state-affiliated", "state-affiliated"),
            F.when(F.col("loaded_density") >= 1.2, "emotive-language"),
            F.when(_hits(F.col("_title"), LOADED) > 0, "charged-headline"),
            F.when(F.rtrim(text("title")).endswith("?"), "question-headline"),
            F.when(text("title").rlike("[“\"'].+[”\"']") & (F.length(text("title")) > 30), "quote-headline"),
            F.when(F.col("n_weak") > 0, "anonymous-sourcing"),
            F.when(political & (actors >= 3) & (imbalance >= 0.6), "one-sided-attribution"),
        )
    )
    some_topic = F.size(F.coalesce("topics", F.array().cast("array<string>"))) > 0
    return df.withColumns(
        {
            "subjectivity": F.round(subjectivity, 3),
            "lean_score": F.when(political, F.round(score, 3)).otherwise(0.0),
            "lean": F.when(political, lean_of(score)).otherwise("not-applicable"),
            "confidence": F.when(political, confidence).otherwise(F.when(some_topic, "medium").otherwise("low")),
            "framing": F.array_sort(flags),
        }
    ).drop("_blob", "_words", "_title", "_section", "_prior")


def coverage(df: DataFrame, group: str) -> DataFrame:
    """Per group: articles, outlets, opinions, the spread of lean scores over political articles (0 for fewer than two), and the headline words of one side only.

    Needs title, source_id, lean, lean_score, is_opinion. Only distinct words and counts are gathered.
    """
    political = is_political(F.col("lean"))
    base = df.groupBy(group).agg(
        F.count("*").alias("n_articles"),
        F.countDistinct("source_id").alias("n_sources"),
        F.count_if(F.coalesce("is_opinion", F.lit(False))).alias("n_opinion"),
        F.round(F.when(F.count_if(political) >= 2, F.max(F.when(political, F.col("lean_score"))) - F.min(F.when(political, F.col("lean_score")))).otherwise(0.0), 3).alias("lean_spread"),
    )
    side = F.when(political & (F.col("lean_score") < -0.15), "l").when(political & (F.col("lean_score") > 0.15), "r")
    words = df.withColumn("side", side).where("side is not null").select(group, "side", F.explode_outer(X.tokens(F.col("title"))).alias("w"))
    split = words.groupBy(group, "w").agg(F.max(F.col("side") == "l").alias("l"), F.max(F.col("side") == "r").alias("r"))
    pick = lambda a, b: F.slice(F.array_sort(F.collect_set(F.when(F.col(a) & ~F.col(b), F.col("w")))), 1, 12)
    terms = split.groupBy(group).agg(pick("l", "r").alias("only_left"), pick("r", "l").alias("only_right"), F.max("l").alias("has_l"), F.max("r").alias("has_r"))
    none = F.array().cast("array<string>")
    out = base.join(terms, group, "left")
    return out.select(
        group, "n_articles", "n_sources", "n_opinion", "lean_spread",
        F.when(F.col("has_r"), F.col("only_left")).otherwise(none).alias("left_terms"), F.when(F.col("has_l"), F.col("only_right")).otherwise(none).alias("right_terms"),
    )


def badge(bias: Column) -> Column:
    """(lean, basis): the article's own lean, else the prior of its source, else none."""
    lean, prior = F.coalesce(bias["lean"], F.lit("unknown")), F.coalesce(bias["source_lean"], F.lit("unknown"))
    basis = F.when(bias.isNull(), "none").when(lean != "unknown", "article").when(~prior.isin("unknown", "not-applicable"), "source").otherwise("none")
    shown = F.when(basis == "article", lean).when(basis == "source", prior).otherwise("unknown")
    return F.struct(shown.alias("lean"), basis.alias("basis"))
