"""Reports and payloads: ingest counters, rationale of a framing verdict, JSON in and out, briefing payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.functions import text as X
from pressloom.operators import framing
from pressloom.operators.summarize import best_text

BIAS = "lean string, lean_score double, confidence string, subjectivity double, is_opinion boolean, framing array<string>, signals array<string>, method string, rationale string, source_lean string"
NOT_A_FACT = "Analytical classification, not a statement of fact."


def fetch_counts(fetches: DataFrame) -> DataFrame:
    """One row: sources_total, sources_ok, sources_not_modified, sources_failed of one run's fetches."""
    status = lambda s: F.count_if(F.col("status") == s)
    return fetches.agg(F.count("*").alias("sources_total"), status("ok").alias("sources_ok"), status("not-modified").alias("sources_not_modified"), status("error").alias("sources_failed"))


def report_line(inserted: Column, updated: Column, dropped: Column, clusters: Column, ok: Column, unchanged: Column, failed: Column, total: Column) -> Column:
    """The counters of an ingest run as one line; sources that had nothing new count as fine."""
    return F.format_string("%d new, %d updated, %d duplicates dropped, %d story clusters, %d/%d sources ok (%d unchanged since the last fetch, %d failed)", inserted, updated, dropped, clusters, ok + unchanged, total, unchanged, failed)


def with_rationale(assessed: DataFrame) -> DataFrame:
    """The result of :func:`framing.assess` with ``signals`` (the evidence as sentences, the source's prior first) and ``rationale``."""
    prior, conf = F.coalesce("source_lean", F.lit("unknown")), F.coalesce("source_confidence", F.lit("low"))
    known, title = framing.is_political(prior), F.coalesce("title", F.lit(""))
    frames = F.col("n_left") + F.col("n_right")
    count = lambda text, c: F.when(F.col(c) > 0, F.format_string(text, c))
    charged = F.array_contains("framing", "charged-headline")
    signals = F.array_compact(
        F.array(
            F.when(known, F.concat(F.lit("Source prior: classified "), prior, F.lit(" ("), conf, F.lit(" confidence)"))),
            F.when(F.array_contains("framing", "opinion"), "Published as opinion or commentary"),
            F.when(F.array_contains("framing", "commentary-style"), F.format_string("Commentary markers (%d)", "n_opinion")),
            F.when(F.array_contains("framing", "emotive-language"), F.format_string("Emotive wording (%d words)", "n_loaded")),
            F.when(charged, "Headline uses charged wording"),
            F.when(F.rtrim(title).endswith("?"), "Headline is a question"),
            count("Named or documentary attribution (%d)", "n_strong"),
            count("Unnamed or hedged attribution (%d)", "n_weak"),
            F.when((F.col("lean") != "not-applicable") & (frames > 0), F.format_string("Direction words: %d left, %d right", "n_left", "n_right")),
            F.when(known & (F.col("lean") != prior) & (F.col("lean") != "not-applicable"), F.concat(F.lit("Signals of the article place it at "), F.col("lean"), F.lit(", its source at "), prior)),
        )
    )
    rationale = F.when(F.col("lean") == "not-applicable", "No political direction was measured.").otherwise(F.concat(F.lit("Blend of the source prior ("), prior, F.lit(") and evidence in the text. A rough indicator, no verdict.")))
    return assessed.withColumns({"signals": F.when(F.size(signals) > 0, signals).otherwise(F.array(F.lit("No strong framing signals detected"))), "rationale": rationale})


def bias_json(bias: Column) -> Column:
    """A framing struct as JSON with the note that it is no fact; null stays null."""
    return F.when(bias.isNotNull(), F.to_json(F.struct(*[(F.round(bias[c], 3) if c in ("lean_score", "subjectivity") else bias[c]).alias(c) for c in (x.split()[0] for x in BIAS.split(", "))], F.lit(NOT_A_FACT).alias("disclaimer"))))


def bias_of(json: Column) -> Column:
    """The struct of a JSON text, with a default for everything missing, unknown or unreadable."""
    raw = F.from_json(json, BIAS)
    one_of = lambda c, names, other: F.when(c.isin(*names), c).otherwise(other)
    none = F.array().cast("array<string>")
    return F.struct(
        one_of(raw["lean"], framing.BUCKETS, "unknown").alias("lean"), F.coalesce(raw["lean_score"], F.lit(0.0)).alias("lean_score"), one_of(raw["confidence"], ("low", "medium", "high"), "low").alias("confidence"),
        F.coalesce(raw["subjectivity"], F.lit(0.0)).alias("subjectivity"), F.coalesce(raw["is_opinion"], F.lit(False)).alias("is_opinion"), F.coalesce(raw["framing"], none).alias("framing"), F.coalesce(raw["signals"], none).alias("signals"),
        F.coalesce(F.nullif(raw["method"], F.lit("")), F.lit("heuristic")).alias("method"), F.coalesce(raw["rationale"], F.lit("")).alias("rationale"), one_of(raw["source_lean"], framing.BUCKETS, "unknown").alias("source_lean"),
    )


def json_in(text: Column) -> Column:
    """The JSON object inside free text, from the first opening to the last closing brace, as a variant; null where there is none."""
    return F.try_parse_json(F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0), F.lit("")))


def framing_line(bias: Column) -> Column:
    """One line on the framing of an article: lean and confidence, opinion, the first four markers. Empty without a verdict."""
    none = F.array().cast("array<string>")
    marks = F.slice(F.coalesce(bias["framing"], none), 1, 4)
    lean = F.when(framing.is_political(bias["lean"]), F.concat(F.lit("framing classified "), bias["lean"], F.lit(" ("), F.coalesce(bias["confidence"], F.lit("low")), F.lit(" confidence)"))).when(bias["lean"] == "not-applicable", "no political framing detected")
    return F.concat_ws("; ", lean, F.when(F.coalesce(bias["is_opinion"], F.lit(False)), "opinion/commentary"), F.when(F.size(marks) > 0, F.concat(F.lit("markers: "), F.array_join(marks, ", "))))


def key_sentences(df: DataFrame, id_col: str = "id", most: int = 2, looked_at: int = 20) -> DataFrame:
    """(id, sentences): the ``most`` sentences of an article with the most framing words, best first, earlier first among equals; of its first ``looked_at`` sentences, a limit of the feature."""
    first = F.slice(X.sentences(best_text()), 1, looked_at)
    hits = lambda ws, terms: F.size(F.array_intersect(ws, F.array(*[F.lit(t) for t in dict.fromkeys(terms)])))
    rows = df.select(F.col(id_col).alias("id"), F.posexplode(first).alias("pos", "s")).withColumn("w", F.array_distinct(X.tokens(F.col("s"), drop_stopwords=False)))
    score = 2.0 * hits(F.col("w"), framing.LOADED) + hits(F.col("w"), [*framing.LEFT, *framing.RIGHT]) + F.when(F.col("s").rlike(framing.WEAK), 1.0).otherwise(0.0)
    kept = rows.withColumn("v", score).where(F.col("v") > 0).groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("v"), "pos", "s"))).alias("r"))
    return kept.select("id", F.transform(F.slice("r", 1, most), lambda x: x["s"]).alias("sentences"))


def payload(stories: DataFrame, now: Column, interests: list[str], pool: DataFrame, lookback: float, engine: str = "extractive") -> DataFrame:
    """One row: the briefing as JSON with its counts. ``stories``: section_no, section, place, id, title, summary, source_count (at most thirty rows).

    Without stories the reason is named: nothing was ingested, or nothing matched.
    """
    story = F.struct("place", "id", "title", "summary", "source_count")
    parts = stories.groupBy("section_no", "section").agg(F.array_sort(F.collect_list(story)).alias("stories"))
    whole = parts.agg(F.array_sort(F.collect_list(F.struct("section_no", F.col("section").alias("name"), "stories"))).alias("sections"), F.coalesce(F.sum(F.size("stories")), F.lit(0)).alias("story_count"))
    size = pool.agg(F.count("*").alias("article_pool"))
    out = whole.join(F.broadcast(size))  # one row
    reason = F.when(F.col("article_pool") == 0, "no articles have been ingested yet").when(F.col("story_count") == 0, "none of the recently ingested articles matched your interests").otherwise("")
    body = F.struct(
        F.date_format(now, "yyyy-MM-dd").alias("date"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generated_at"), F.when(F.col("story_count") > 0, engine).otherwise("none").alias("engine"),
        F.array(*map(F.lit, interests)).cast("array<string>").alias("interests"), "sections", "story_count", "article_pool", F.lit(lookback).alias("lookback_hours"), reason.alias("empty_reason"),
    )
    return out.select(now.alias("generated_at"), "story_count", "article_pool", reason.alias("empty_reason"), F.to_json(body).alias("payload"))


def slug(text: Column) -> Column:
    """Small letters and digits joined by hyphens; ``topic`` where nothing is left."""
    out = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(out == "", "topic").otherwise(out)


def relative_time(then: Column, now: Column) -> Column:
    """A time against now, in minutes, hours or days, in either direction; a date from eight days back."""
    minutes = F.round((F.unix_seconds(now) - F.unix_seconds(then)) / 60).cast("long")
    hours = lambda m: F.round(m / 60).cast("long")
    days = lambda m: F.round(hours(m) / 24).cast("long")

    def span(m: Column, text: str, far: Column) -> Column:
        said = lambda n, unit: F.format_string(text, n, F.lit(unit))
        return F.when(m < 60, said(m, "m")).when(hours(m) < 24, said(hours(m), "h")).otherwise(far)

    ahead = span(-minutes, "in %d%s", F.format_string("in %dd", days(-minutes)))
    back = span(minutes, "%d%s ago", F.when(days(minutes) < 8, F.format_string("%dd ago", days(minutes))).otherwise(F.date_format(then, "yyyy-MM-dd")))
    return F.when(then.isNull(), "no date").when(minutes <= -1, ahead).when(minutes < 1, "just now").otherwise(back)
