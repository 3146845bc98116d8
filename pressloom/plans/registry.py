"""Queries of the core operators over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.functions import text as X
from pressloom.functions.urls import canonical_url as canonical
from pressloom.operators import answers, briefing, cluster, dedupe, framing, interests, normalize, state, summarize, timestamps, topics
from pressloom.plans.oracles import ORACLES
from pressloom.search import question, ranking
from pressloom.search.index import SearchIndex
from pressloom.session import shared_dir
from pressloom.sources import feeds
from pressloom.sources.tables import table
from pressloom.streaming import feed_state, ingest

Query = Callable[[SparkSession, str], DataFrame]
#: The clock of the queries: later than all test data, and given, so results don't depend on when they run.
def now():
    return F.to_timestamp(F.lit("2025-03-01 00:00:00"))


#: The question of the ranking queries.
ASKED = "How was the satellite budget of the planetarium approved?"
READER = "space, security and culture"


# ---- timestamps
def written_times(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, row_id, source_id, written) of both tables with written times."""
    articles = table(spark, d, "articles").select(F.lit("articles").alias("tbl"), F.col("id").alias("row_id"), "source_id", F.col("published_at").alias("written"))
    entries = table(spark, d, "raw_entries").select(F.lit("raw_entries").alias("tbl"), F.col("entry_id").alias("row_id"), "source_id", F.col("published").alias("written"))
    return articles.unionByName(entries)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    out = timestamps.normalise(written_times(spark, d), table(spark, d, "feed_clock"))
    return out.where("utc_second is not null").select("tbl", "row_id", "utc_second")


def p1_status_by_source(spark: SparkSession, d: str) -> DataFrame:
    """How many times of each source were read, by layout and status: where ambiguity is left, it shows."""
    out = timestamps.normalise(written_times(spark, d), table(spark, d, "feed_clock"))
    return out.groupBy("tbl", "source_id", F.coalesce("layout", F.lit("none")).alias("layout"), "status").agg(F.count("*").alias("n_values"))


def p1_without_hint(spark: SparkSession, d: str) -> DataFrame:
    """How far the mixture alone, with the clocks' order of slashed dates withheld, agrees with the answer that has it, by source."""
    rows, clocks = written_times(spark, d), table(spark, d, "feed_clock")
    told = timestamps.normalise(rows, clocks).select("tbl", "row_id", F.col("source_id").alias("s"), F.col("utc_second").alias("told"))
    alone = timestamps.normalise(rows, clocks.withColumn("day_first", F.lit(None).cast("boolean"))).select("tbl", "row_id", "utc_second", "status")
    both = told.join(alone, ["tbl", "row_id"])
    return both.groupBy(F.col("s").alias("source_id")).agg(
        F.count_if(F.col("told").isNotNull()).alias("n_told"), F.count_if(F.col("told") == F.col("utc_second")).alias("n_same"), F.count_if(F.col("told").isNotNull() & (F.col("status") == "ambiguous")).alias("n_ambiguous"),
        F.count_if(F.col("utc_second").isNotNull() & ~F.col("utc_second").eqNullSafe(F.col("told"))).alias("n_other"),
    )


# ---- text functions
def token_stats(spark: SparkSession, d: str) -> DataFrame:
    words = X.tokens(F.col("text"), drop_stopwords=False)
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))


def token_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "articles", "title").select(F.explode(F.array_distinct(X.tokens(F.col("title"), drop_stopwords=False))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("df"))


def distinctive_words(spark: SparkSession, d: str) -> DataFrame:
    """Headline words that at most six headlines have."""
    return token_document_frequency(spark, d).where((F.col("df") <= 6) & (F.length("token") >= 4) & ~F.col("token").rlike("^[0-9]+$"))


def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    s = X.sentences(F.col("text"), 1)
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.get(s, F.lit(0)).alias("first_sentence"))


def truncated_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles", "id", "title").select("id", X.truncate(F.col("title"), 40).alias("short_title"))


def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles", "id", "title", "canonical_url").select("id", X.content_hash(F.col("title"), F.col("canonical_url")).alias("digest"))


def title_simhash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles", "id", "title").select("id", X.simhash(X.tokens(F.col("title"), drop_stopwords=False)).alias("hash"))


def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles", "id", "url").select("id", canonical(F.col("url")).alias("key"))


def html_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_entries", "entry_id", "summary").select("entry_id", X.strip_html(F.col("summary")).alias("text"))


def entity_lists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles", "id", "title", "summary").select("id", X.entities(F.concat_ws(". ", "title", "summary")).alias("names"))


# ---- feeds and normalisation
def feed_parse(spark: SparkSession, d: str) -> DataFrame:
    return feeds.feed_items(table(spark, d, "raw_feeds").where("status = 'ok'"))


def normalized_entries(spark: SparkSession, d: str) -> DataFrame:
    keep = ["entry_id", "source_id", "title", "canonical_url", "summary", "content", "author", "language"]
    return normalize.articles_of(table(spark, d, "raw_entries")).select(*keep)


def newest_per_source(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles", "id", "source_id", "retrieved_at")
    return normalize.newest(rows, ["source_id"], F.col("retrieved_at"), 40, "id").select("id", "source_id")


# ---- duplicates and stories
def richest_copy(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles", "id", "url", "content", "summary", "published_at")
    return dedupe.richest(rows, canonical(F.col("url")), "id", F.coalesce("published_at", F.lit("")) != "")


def content_hash_copies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles", "content_hash").where("content_hash <> ''").groupBy("content_hash").agg(F.count("*").alias("n_copies")).where("n_copies > 1")


def exact_kept(spark: SparkSession, d: str) -> DataFrame:
    """Exact duplicates by address or content hash: what is kept in whose place."""
    return dedupe.exact_kept(table(spark, d, "articles", "id", "canonical_url", "url", "content_hash", "content", "summary", "published_at"))


def near_text_links(spark: SparkSession, d: str) -> DataFrame:
    """Classes and links of near-duplicates in a source by title and summary."""
    return dedupe.near_links(table(spark, d, "articles", "id", "source_id", "title", "summary"), "id", "source_id", "title", "summary")


def near_title_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.near_pairs(table(spark, d, "articles", "id", "source_id", "title"), "id", "source_id", "title")


def near_title_kept(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.first_kept(table(spark, d, "articles", "id"), near_title_pairs(spark, d))


def _story_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles", "id", "title", "entities", "retrieved_at")


def story_pairs(spark: SparkSession, d: str) -> DataFrame:
    return cluster.story_pairs(_story_rows(spark, d), "id", "title", "entities", F.col("retrieved_at"))


def story_members(spark: SparkSession, d: str) -> DataFrame:
    return cluster.stories(_story_rows(spark, d), "id", "title", "entities", F.col("retrieved_at"))


def story_ids(spark: SparkSession, d: str) -> DataFrame:
    return cluster.story_ids(story_members(spark, d), table(spark, d, "articles", "id", "canonical_url"))


def reclustered(spark: SparkSession, d: str) -> DataFrame:
    """The stories of the last 48 hours."""
    rows = table(spark, d, "articles", "id", "title", "entities", "retrieved_at", "canonical_url")
    marked = rows.join(F.broadcast(rows.agg(F.max("retrieved_at").alias("now"))))  # one row
    return cluster.recluster(marked, "id", "title", "entities", F.col("retrieved_at"), F.col("now"))


def story_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many stories there are of each size."""
    sizes = story_members(spark, d).groupBy("story").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("n_stories"))


def story_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles", "id", "cluster_id", "source_id", "retrieved_at")
    return cluster.story_groups(rows, "id", "cluster_id", F.col("retrieved_at"))


# ---- relational
def enabled_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources", "id", "name", "enabled").where("enabled").select("id", F.lower("name").alias("name"))


def enriched_articles(spark: SparkSession, d: str) -> DataFrame:
    dim = table(spark, d, "sources", "id", "lean", "source_type", "country").withColumnsRenamed({"id": "source_id", "lean": "outlet_lean"})
    return table(spark, d, "articles", "id", "source_id").join(dim, "source_id", "left").select("id", "outlet_lean", "source_type", "country")


def ingest_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles", "source_id", "retrieved_at")
    now = rows.agg(F.max("retrieved_at").alias("now"))
    marked = rows.join(F.broadcast(now))  # one row
    day = F.timestamp_micros(F.unix_micros("now") - 86400 * 1000000)
    return marked.agg(F.count("*").alias("n_articles"), F.countDistinct("source_id").alias("n_sources"), F.date_format(F.max("retrieved_at"), "yyyy-MM-dd HH:mm:ss").alias("newest"), F.count_if(F.col("retrieved_at") >= day).alias("n_last_day"))


def recent_articles(spark: SparkSession, d: str) -> DataFrame:
    """The hundred newest articles, a limit of the report."""
    return table(spark, d, "articles", "id", "retrieved_at").orderBy(F.desc("retrieved_at"), "id").limit(100).select("id")


def retention(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles", "id", "retrieved_at")
    return state.retained(rows, F.col("retrieved_at"), F.to_timestamp(F.lit("2024-06-01 00:00:00")), 180).select("id")


def feed_streaks(spark: SparkSession, d: str) -> DataFrame:
    runs = state.feed_runs(table(spark, d, "raw_feeds", "source_id", "fetched_at", "status").distinct())
    return runs.groupBy("source_id").agg(F.max("streak").cast("long").alias("worst"), F.count("*").alias("n_fetches"))


def feed_states(spark: SparkSession, d: str) -> DataFrame:
    out = state.feed_state(table(spark, d, "raw_feeds", "source_id", "fetched_at", "status", "etag").distinct())
    return out.select("source_id", F.date_format("last_fetch", "yyyy-MM-dd HH:mm:ss").alias("last_fetch"), F.date_format("last_success", "yyyy-MM-dd HH:mm:ss").alias("last_success"), "last_status", "failures")


def due_feeds(spark: SparkSession, d: str) -> DataFrame:
    st = state.feed_state(table(spark, d, "raw_feeds", "source_id", "fetched_at", "status", "etag").distinct())
    return state.due_feeds(table(spark, d, "sources", "id", "enabled"), st, 2).select("id", "failures")


def new_entries(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of feed items that no article of the earlier half of the runs has: all items against what was stored then."""
    items = table(spark, d, "raw_entries", "link").select(canonical(F.col("link")).alias("canonical_url")).where("canonical_url <> ''").distinct()
    rows = table(spark, d, "articles", "canonical_url", "run_no")
    middle = F.broadcast(rows.agg(((F.min("run_no") + F.max("run_no")) / 2).alias("m")))  # one row
    return state.unknown(items, rows.join(middle).where("run_no <= m"), "canonical_url")


def known_entries(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "raw_entries", "link").select(canonical(F.col("link")).alias("canonical_url")).where("canonical_url <> ''").distinct()
    return items.join(table(spark, d, "articles", "canonical_url"), "canonical_url", "left_semi")


def upserted_articles(spark: SparkSession, d: str) -> DataFrame:
    """The first half of the runs, then the other half upserted into it; the latest row of an address stands for it."""
    cols = ["id", "canonical_url", "title", "summary", "content", "published_at", "cluster_id", "source_id", "run_no"]
    rows = table(spark, d, "articles", *cols).where("canonical_url is not null")
    middle = F.broadcast(rows.agg(((F.min("run_no") + F.max("run_no")) / 2).alias("m")))  # one row
    marked = rows.join(middle).withColumn("late", F.col("run_no") > F.col("m"))
    last = marked.groupBy("canonical_url", "late").agg(F.max_by(F.struct(*cols), "id").alias("r")).select("r.*", "late")
    old, new = (last.where("late" if late else "not late").drop("late") for late in (False, True))
    out = state.upsert_articles(old, new)
    return out.select("canonical_url", "id", "title", F.length(F.coalesce("summary", F.lit(""))).cast("long").alias("n_summary"), F.length(F.coalesce("content", F.lit(""))).cast("long").alias("n_content"), "published_at", "change")


def newest_fetches(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_feeds", "source_id", "fetched_at", "status").distinct()
    return state.keep_last(rows, ["source_id"], [F.desc("fetched_at"), F.col("status")], 3).select("source_id", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched"), "status")


def unused_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources", "id").join(table(spark, d, "articles", F.col("source_id").alias("id")), "id", "left_anti")


def event_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return table(spark, d, "events", "event_type", "props").groupBy("event_type").agg(F.count("*").alias("n_events"), F.sum(k).alias("sum_k"), F.max(k).alias("max_k"))


def lean_shares(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    per = table(spark, d, "articles", "bias").groupBy(F.coalesce("bias.lean", F.lit("unknown")).alias("lean")).agg(F.count("*").alias("n"))
    return per.select("lean", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6).alias("share"))  # one row a lean


# ---- topics, framing, interests
def _with_sources(spark: SparkSession, d: str) -> DataFrame:
    dim = table(spark, d, "sources").select(F.col("id").alias("source_id"), F.col("lean").alias("source_lean"), F.col("confidence").alias("source_confidence"), "source_type")
    rows = table(spark, d, "articles", "id", "title", "summary", "content", "url", "topics", "entities", "source_id", "cluster_id", "canonical_url", "retrieved_at")
    return rows.join(dim, "source_id", "left")


def topic_points(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles", "id", "title", "summary", "content")
    return topics.scored(rows).select("id", F.explode("topic_scores").alias("topic", "points")).select("id", "topic", F.round("points", 6).alias("points"))


def article_topics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles", "id", "title", "summary", "content")
    return topics.with_topics(rows).select("id", F.array_join("topics", ",").alias("topics"))


def hinted_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topics with the categories of items and sources."""
    dim = F.broadcast(table(spark, d, "sources", F.col("id").alias("source_id"), F.col("categories").alias("source_categories")))  # the registry is small
    rows = table(spark, d, "articles", "id", "title", "summary", "content", "feed_categories", "source_id").join(dim, "source_id", "left")
    return topics.with_topics(rows, hints=True).select("id", F.array_join("topics", ",").alias("topics"))


def framing_measures(spark: SparkSession, d: str) -> DataFrame:
    cols = ["n_loaded", "n_opinion", "n_left", "n_right", "n_left_actors", "n_right_actors"]
    return framing.assess(_with_sources(spark, d)).select("id", *[F.col(c).cast("long").alias(c) for c in cols])


def article_framing(spark: SparkSession, d: str) -> DataFrame:
    out = framing.assess(_with_sources(spark, d))
    return out.select("id", "lean", "lean_score", "confidence", "subjectivity", "is_opinion", F.array_join("framing", ",").alias("framing"))


def lean_badges(spark: SparkSession, d: str) -> DataFrame:
    b = framing.badge(F.col("bias"))
    return table(spark, d, "articles", "id", "bias").select("id", b["lean"].alias("shown_lean"), b["basis"].alias("basis"))


def story_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles", "cluster_id", "title", "source_id", "bias").where("cluster_id <> ''")
    rows = rows.select("cluster_id", "title", "source_id", F.coalesce("bias.lean", F.lit("unknown")).alias("lean"), F.coalesce("bias.lean_score", F.lit(0.0)).alias("lean_score"), F.coalesce("bias.is_opinion", F.lit(False)).alias("is_opinion"))
    return framing.coverage(rows, "cluster_id").select("cluster_id", "n_articles", "n_sources", "n_opinion", "lean_spread")


def story_headline_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles", "cluster_id", "title", "source_id", "bias").where("cluster_id <> ''")
    rows = rows.select("cluster_id", "title", "source_id", F.coalesce("bias.lean", F.lit("unknown")).alias("lean"), F.coalesce("bias.lean_score", F.lit(0.0)).alias("lean_score"), F.lit(False).alias("is_opinion"))
    return framing.coverage(rows, "cluster_id").select("cluster_id", "left_terms", "right_terms")


def interest_scores(spark: SparkSession, d: str) -> DataFrame:
    who = interests.parse_interests(READER)
    out = interests.with_interests(table(spark, d, "articles", "id", "title", "summary", "content", "topics", "entities"), who)
    return out.select("id", F.round("interest", 6).alias("interest"), "labels")


# ---- search and answers
_PLANS: dict[str, question.Question] = {}


def _asked(spark: SparkSession) -> question.Question:
    """The plan of the question, made once in a session."""
    key = spark.sparkContext.applicationId
    if key not in _PLANS:
        _PLANS[key] = question.parse(spark, ASKED, lex=topics.lexicon())
    return _PLANS[key]


_BUILT: dict[tuple[str, str], SearchIndex] = {}


def _index(spark: SparkSession, d: str) -> SearchIndex:
    """The index of the articles of a folder, built once in a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _BUILT:
        rows = table(spark, d, "articles", "id", "retrieved_at", *ranking.WEIGHTS)
        _BUILT[key] = SearchIndex(spark, f"{shared_dir(spark).rstrip('/')}/search-{uuid.uuid4().hex}", ranking.WEIGHTS).add(rows, 0, "retrieved_at")
    return _BUILT[key]


def bm25_top20(spark: SparkSession, d: str) -> DataFrame:
    """The twenty best articles for three words, by weighted BM25 over all five columns of the stored index."""
    index = _index(spark, d)
    found = ranking.bm25_of(index.matches([ranking.Phrase((w,)) for w in ("satellite", "planetarium", "budget")]), [0, 1, 2], corpus=index.figures())
    return found.select("id", F.round("bm25", 9).alias("bm25")).orderBy(F.desc("bm25"), "id").limit(20)


def index_size(spark: SparkSession, d: str) -> DataFrame:
    """What the index holds after the later half of the runs replaced its first rows and every tenth article was removed."""
    rows = table(spark, d, "articles", "id", "run_no", "retrieved_at", *ranking.WEIGHTS)
    index = SearchIndex(spark, f"{shared_dir(spark).rstrip('/')}/search-{uuid.uuid4().hex}", ranking.WEIGHTS)
    index.add(rows.drop("run_no"), 0, "retrieved_at").add(rows.where("run_no % 2 = 0").drop("run_no"), 1, "retrieved_at").remove(rows.where("id % 10 = 0"), 2)
    return index.figures().select(F.col("_rows").alias("n_rows"), F.round("_avg", 6).alias("mean_length"))


def _search_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles", "id", "title", "summary", "content", "entities", "topics", "source_id", "source_name", "cluster_id", "retrieved_at")


def question_coverage(spark: SparkSession, d: str) -> DataFrame:
    cover, _, _ = ranking.term_coverage(_asked(spark))
    return _search_rows(spark, d).select("id", F.round(cover, 6).alias("coverage"))


def ranked_answers(spark: SparkSession, d: str) -> DataFrame:
    q = _asked(spark)
    return ranking.retrieve(_search_rows(spark, d), q, now(), "retrieved_at", widest=24 * 3650, index=_index(spark, d)).select("id", F.round("score", 9).alias("score"), "reasons")


def diversified_answers(spark: SparkSession, d: str) -> DataFrame:
    ranked = ranking.retrieve(_search_rows(spark, d), _asked(spark), now(), "retrieved_at", widest=24 * 3650, index=_index(spark, d))
    return ranking.diversified(ranked, 8)


def grounded_answer(spark: SparkSession, d: str) -> DataFrame:
    rows = _search_rows(spark, d)
    top = ranking.diversified(ranking.retrieve(rows, _asked(spark), now(), "retrieved_at", widest=24 * 3650, index=_index(spark, d)), 8)
    picked = rows.join(F.broadcast(top), "id")  # at most eight rows
    briefs = summarize.summaries(picked, "id")
    stories = picked.join(briefs, "id").select((F.col("place") + 1).alias("place"), "title", "source_name", "brief", F.array().cast("array<string>").alias("outlets"))
    return answers.extractive_answer(stories, ASKED)


def citation_check(spark: SparkSession, d: str) -> DataFrame:
    """Every document as an answer with right and wrong citations at its end."""
    mark = F.concat(F.lit(" ["), (F.col("doc_id") % 5).cast("string"), F.lit("] [7]["), (F.col("doc_id") % 12).cast("string"), F.lit("]."))
    text = F.concat(F.coalesce("text", F.lit("")), mark)
    c = answers.citations(text, F.lit(3))
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.array_join(c["valid"].cast("array<string>"), ",").alias("valid"), F.array_join(F.array_sort(c["invalid"]), ",").alias("invalid"), F.length(c["text"]).cast("long").alias("n_clean"))


def turn_intents(spark: SparkSession, d: str) -> DataFrame:
    """Intent and time window of headlines read as questions."""
    return table(spark, d, "articles", "id", "title").select("id", question.intent_column(F.col("title")).alias("intent"), question.hours_column(F.col("title")).alias("hours"))


# ---- summaries and briefing
def sentence_ranks(spark: SparkSession, d: str) -> DataFrame:
    rows = summarize.sentence_scores(table(spark, d, "documents", "doc_id", "text"), "doc_id", X.sentences(F.col("text")))
    return rows.select(F.col("id").alias("doc_id"), F.col("pos").cast("long").alias("pos"), F.round("score", 6).alias("score"))


def article_briefs(spark: SparkSession, d: str) -> DataFrame:
    return summarize.summaries(table(spark, d, "articles", "id", "title", "summary", "content"), "id")


def story_briefs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles", "id", "cluster_id", "summary", "content").where("cluster_id <> ''")
    return summarize.group_summaries(rows, "cluster_id", "id")


def _briefing(spark: SparkSession, d: str) -> tuple[DataFrame, list]:
    who = interests.parse_interests(READER)
    rows = framing.assess(_with_sources(spark, d))
    return briefing.ranked(rows, who, now(), F.col("retrieved_at"), lookback=24.0 * 3650), who


def briefing_ranks(spark: SparkSession, d: str) -> DataFrame:
    df, _ = _briefing(spark, d)
    return df.select("id", F.round("rank_score", 6).alias("rank_score"))


def briefing_stories(spark: SparkSession, d: str) -> DataFrame:
    df, _ = _briefing(spark, d)
    return briefing.grouped(df).select("story_key", "id", "n_members", "n_sources", F.round("group_score", 6).alias("group_score"))


def briefing_sections(spark: SparkSession, d: str) -> DataFrame:
    df, who = _briefing(spark, d)
    return briefing.sections(briefing.grouped(df), who)


# ---- streaming
def _replay(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table, one file or a folder of files, as a stream. The braces make the path a pattern: only as such may it name a file."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{{{name}}}.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """The events replayed as a stream, counted by day and type."""
    path = _folder(spark, "daily")
    counts = ingest.daily_counts(_replay(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    ingest.run_batches(counts, ingest.upsert_step(f"{path}/counts"), f"{path}/checkpoint", mode="update").awaitTermination()
    return ingest.keep_latest(spark, f"{path}/counts", ["day", "event_type"]).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n")


def stream_feed_states(spark: SparkSession, d: str) -> DataFrame:
    """The fetches replayed as a stream, with the state of each feed kept between batches."""
    path = _folder(spark, "feeds")
    fetches = _replay(spark, d, "raw_feeds").select("source_id", "fetched_at", "status", "etag").distinct()
    ingest.run_batches(feed_state.feed_states(fetches), ingest.upsert_step(f"{path}/states"), f"{path}/checkpoint", mode="update").awaitTermination()
    out = ingest.keep_latest(spark, f"{path}/states", ["source_id"])
    shown = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("source_id", shown("last_fetch"), shown("last_success"), "last_status", "failures")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        bm25_top20, index_size, p1_found, p1_status_by_source, p1_without_hint,
        token_stats, token_document_frequency, distinctive_words, sentence_counts, truncated_titles, content_hashes, title_simhash, canonical_urls, html_text, entity_lists,
        feed_parse, normalized_entries, newest_per_source,
        richest_copy, content_hash_copies, exact_kept, near_text_links, near_title_pairs, near_title_kept, story_pairs, story_members, story_ids, reclustered, story_sizes, story_groups,
        enabled_sources, enriched_articles, ingest_stats, recent_articles, retention, feed_streaks, feed_states, due_feeds, new_entries, known_entries, upserted_articles, newest_fetches, unused_sources, event_props, lean_shares,
        topic_points, article_topics, hinted_topics, framing_measures, article_framing, lean_badges, story_coverage, story_headline_terms, interest_scores,
        question_coverage, ranked_answers, diversified_answers, grounded_answer, citation_check, turn_intents,
        sentence_ranks, article_briefs, story_briefs, briefing_ranks, briefing_stories, briefing_sections,
        stream_daily_counts, stream_feed_states,
    )
}
__all__ = ["ORACLES", "QUERIES"]
