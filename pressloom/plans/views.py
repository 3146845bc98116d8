"""Queries of comparison, stored tables, reports and filters, with the SQL each is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.functions import text as X
from pressloom.operators import comparison, framing, reports, state, store, summarize
from pressloom.plans.oracles import toks
from pressloom.session import spool
from pressloom.sources.tables import table


def _newest(spark: SparkSession, d: str) -> DataFrame:
    """The newest time of the articles: the clock of these queries, one row."""
    return F.broadcast(table(spark, d, "articles", "retrieved_at").agg(F.max("retrieved_at").alias("now")))


# ---- filters, orders, lookups
def sources_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Sources in the order of their names, capitals aside, with their place."""
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.orderBy(F.lower("name"), "id"))  # the registry is small
    return table(spark, d, "sources", "id", "name").select("id", "name", place.cast("long").alias("place"))


def source_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources", "enabled").agg(F.count("*").alias("n_sources"), F.count_if("enabled").alias("n_enabled"))


def source_search(spark: SparkSession, d: str) -> DataFrame:
    """Enabled sources with a term anywhere in their shown fields."""
    shown = F.lower(F.concat_ws(" ", "name", "id", "lean", "source_type", "country", F.array_join("categories", " ")))
    return table(spark, d, "sources").where("enabled").where(F.contains(shown, F.lit("center"))).select("id")


def failing_feeds(spark: SparkSession, d: str) -> DataFrame:
    """The ten feeds with most failures in a row, a limit of the report."""
    st = state.feed_state(table(spark, d, "raw_feeds", "source_id", "fetched_at", "status", "etag").distinct())
    return st.where("failures > 0").select("source_id", "failures").orderBy(F.desc("failures"), "source_id").limit(10)


def articles_of_center(spark: SparkSession, d: str) -> DataFrame:
    """Articles of a set of sources: those of the center."""
    chosen = table(spark, d, "sources", "id", "lean").where("lean = 'center'").select(F.col("id").alias("source_id"))
    return table(spark, d, "articles", "id", "source_id").join(F.broadcast(chosen), "source_id", "left_semi").select("id")  # the registry is small


def latest_week(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles", "id", "retrieved_at").join(_newest(spark, d))
    return rows.where(F.unix_micros("retrieved_at") >= F.unix_micros("now") - 7 * 86_400_000_000).select("id")


def known_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of the newest run that earlier runs have, with the first article that has each."""
    rows = table(spark, d, "articles", "id", "run_no", "content_hash").where("content_hash <> ''")
    last = F.broadcast(rows.agg(F.max("run_no").alias("last")))  # one row
    marked = rows.join(last)
    stored = marked.where("run_no < last").groupBy("content_hash").agg(F.min("id").alias("first_id"))
    return stored.join(marked.where("run_no = last").select("content_hash"), "content_hash", "left_semi")


def requested_articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles of a list of ids, with their place in the list: every twentieth, from the last to the first."""
    wanted = table(spark, d, "articles", "id").where("id % 20 = 0")
    order = wanted.select("id", (-F.col("id")).alias("place"))
    return order.join(table(spark, d, "articles", "id", "title"), "id").select("place", "id", "title")


def title_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles", "id", "title").select("id", F.array_join(F.array_sort(F.array_distinct(X.tokens(F.col("title")))), " ").alias("title_key"))


def stories_by_size(spark: SparkSession, d: str) -> DataFrame:
    """Clusters with more than one article."""
    rows = table(spark, d, "articles", "cluster_id").where("cluster_id <> ''")
    return rows.groupBy("cluster_id").agg(F.count("*").alias("size")).where("size > 1")


def unused_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters that no article of the later half of the runs has."""
    rows = table(spark, d, "articles", "cluster_id", "run_no").where("cluster_id <> ''")
    middle = F.broadcast(rows.agg(((F.min("run_no") + F.max("run_no")) / 2).alias("m")))  # one row
    return state.unused(rows.select("cluster_id").distinct(), rows.join(middle).where("run_no > m")).select("cluster_id")


def relative_times(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles", "id", "retrieved_at").join(_newest(spark, d))
    return rows.select("id", reports.relative_time(F.col("retrieved_at"), F.col("now")).alias("shown"))


def source_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources", "id", "name").select("id", reports.slug(F.col("name")).alias("slug"))


# ---- stored tables
def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Sources as stored (a part, names in capitals), and the registry they are synchronised with."""
    rows = table(spark, d, "sources", "id", "name", "lean", "enabled")
    return rows.where(F.col("enabled")).withColumn("name", F.upper("name")), rows.where(F.col("lean") != "center")


def upserted_sources(spark: SparkSession, d: str) -> DataFrame:
    return store.upserted_sources(*_halves(spark, d))


def _clusters(spark: SparkSession, d: str, late: bool) -> DataFrame:
    rows = table(spark, d, "articles", "id", "cluster_id", "run_no", "title").where("cluster_id <> ''")
    middle = F.broadcast(rows.agg(((F.min("run_no") + F.max("run_no")) / 2).alias("m")))  # one row
    part = rows.join(middle).where("run_no > m" if late else "run_no <= m")
    return part.groupBy("cluster_id").agg(F.min_by("title", "id").alias("key_title"), F.count("*").alias("size"))


def upserted_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The clusters of the earlier runs with those of the later ones: sizes are replaced, titles stay."""
    return store.upserted_clusters(_clusters(spark, d, False), _clusters(spark, d, True))


def assigned_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Every third article gets a new cluster, the others keep theirs."""
    rows = table(spark, d, "articles", "id", "cluster_id")
    return store.with_clusters(rows, rows.where("id % 3 = 0").select("id", F.concat(F.lit("new-"), (F.col("id") % 100).cast("string")).alias("cluster_id")))


def reanalysed(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of every fifth article replaced."""
    rows = table(spark, d, "articles", "id", "title", "summary")
    return store.with_analysis(rows, rows.where("id % 5 = 0").select("id", F.concat(F.lit("New: "), "title").alias("summary"))).select("id", "summary")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Headlines as turns of conversations: a source is a session, odd ids are the user."""
    return table(spark, d, "articles", "id", "source_id", "title").select(F.col("source_id").alias("session_id"), "id", F.when(F.col("id") % 2 == 1, "user").otherwise("assistant").alias("role"), F.col("title").alias("content"))


def last_turns(spark: SparkSession, d: str) -> DataFrame:
    return store.last_turns(_turns(spark, d)).select("session_id", F.col("place").cast("long").alias("place"), "id", "role")


def asked_before(spark: SparkSession, d: str) -> DataFrame:
    return store.asked_before(_turns(spark, d), X.tokens(F.col("content"))).select("session_id", "asked_id")


def kept_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Turns that are left when the sessions of disabled sources are deleted, by session."""
    gone = table(spark, d, "sources", "id", "enabled").where("not enabled").select(F.col("id").alias("session_id"))
    return store.without_sessions(_turns(spark, d), gone).groupBy("session_id").agg(F.count("*").alias("n_turns"))


def stale_feeds(spark: SparkSession, d: str) -> DataFrame:
    """Whether each feed's last fetch is older than a day."""
    last = table(spark, d, "raw_feeds", "source_id", "fetched_at").groupBy("source_id").agg(F.max("fetched_at").alias("t"))
    now = F.broadcast(table(spark, d, "raw_feeds", "fetched_at").agg(F.max("fetched_at").alias("now")))  # one row
    return last.join(now).select("source_id", store.is_stale(F.col("t"), F.col("now"), 1440.0).alias("is_stale"))


def latest_payload(spark: SparkSession, d: str) -> DataFrame:
    """Of the feeds as payloads, the newest."""
    rows = table(spark, d, "raw_feeds", "source_id", "fetched_at", "status")
    return store.latest(rows, [F.desc("fetched_at"), F.col("source_id"), F.col("status")]).select("source_id", "status")


# ---- comparison
def _filed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles", "id", "cluster_id", "source_id", "source_name", "title", "bias", "retrieved_at")


def coverage_buckets(spark: SparkSession, d: str) -> DataFrame:
    return comparison.buckets(_filed(spark, d), "cluster_id")


def coverage_outlets(spark: SparkSession, d: str) -> DataFrame:
    return comparison.outlets(_filed(spark, d), "cluster_id", "retrieved_at").withColumn("place", F.col("place").cast("long"))


def coverage_answers(spark: SparkSession, d: str) -> DataFrame:
    return comparison.answers(_filed(spark, d), "cluster_id", "retrieved_at").withColumn("cited", F.array_join(F.col("cited").cast("array<string>"), ","))


def compared_articles(spark: SparkSession, d: str) -> DataFrame:
    """What a comparison looks at when the twelve newest articles of clusters are the hits."""
    rows = table(spark, d, "articles", "id", "cluster_id", "canonical_url", "retrieved_at")
    hits = rows.where("cluster_id <> ''").orderBy(F.desc("retrieved_at"), "id").limit(12).select("id", (1000000.0 - F.col("id")).alias("score"), "cluster_id", "canonical_url")
    return comparison.compared(spool(hits, "hits"), rows.select("id", "cluster_id", "canonical_url")).select("id", "score", F.col("place").cast("long").alias("place"))


# ---- reports
def bias_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Framing verdicts through JSON and back."""
    b = reports.bias_of(reports.bias_json(F.col("bias")))
    return table(spark, d, "articles", "id", "bias").select("id", b["lean"].alias("lean"), b["lean_score"].alias("lean_score"), b["confidence"].alias("confidence"), b["method"].alias("method"), F.array_join(b["framing"], ",").alias("framing"))


def json_in_text(spark: SparkSession, d: str) -> DataFrame:
    """JSON objects fished out of fenced text, and out of text without any."""
    text = F.when(F.col("id") % 4 == 0, F.col("title")).otherwise(F.concat(F.lit("Sure:\n```json\n"), F.to_json(F.struct("id", F.col("source_id").alias("s"))), F.lit("\n```\ndone")))
    return table(spark, d, "articles", "id", "title", "source_id").select("id", F.try_variant_get(reports.json_in(text), "$.s", "string").alias("found"))


def framing_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles", "id", "bias").select("id", reports.framing_line(F.col("bias")).alias("line"))


def key_sentences(spark: SparkSession, d: str) -> DataFrame:
    return reports.key_sentences(table(spark, d, "articles", "id", "summary", "content"))


def framing_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Signals and rationale of every verdict."""
    from pressloom.plans import registry

    out = reports.with_rationale(framing.assess(registry._with_sources(spark, d)))
    return out.select("id", F.size("signals").alias("n_signals"), F.get("signals", F.lit(0)).alias("first_signal"), "rationale")


def fetch_report(spark: SparkSession, d: str) -> DataFrame:
    """The counters of the landed fetches as one line."""
    c = reports.fetch_counts(table(spark, d, "raw_feeds", "status"))
    zero = F.lit(0).cast("long")
    return c.select(reports.report_line(zero, zero, zero, zero, *map(F.col, ("sources_ok", "sources_not_modified", "sources_failed", "sources_total"))).alias("report"))


def briefing_payload(spark: SparkSession, d: str) -> DataFrame:
    """The briefing of the reader as one stored row: counts, reason when empty, JSON."""
    from pressloom.plans import registry

    who = registry.interests.parse_interests(registry.READER)
    placed = spool(registry.briefing_sections(spark, d), "placed")
    rows = table(spark, d, "articles", "id", "title", "summary", "content", "cluster_id", "source_id")
    picked = rows.join(F.broadcast(placed), "id")  # at most thirty rows
    briefs = summarize.summaries(picked.select("id", "title", "summary", "content"), "id").select("id", F.col("brief").alias("summary"))
    outlets = rows.where("cluster_id <> ''").groupBy("cluster_id").agg(F.countDistinct("source_id").alias("n"))
    stories = picked.drop("summary").join(briefs, "id").join(outlets, "cluster_id", "left").withColumn("source_count", F.coalesce("n", F.lit(1)))
    return reports.payload(stories, registry.now(), [i.label for i in who], rows.select("id"), 24.0 * 3650)


def briefing_section_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many stories each section has."""
    from pressloom.plans import registry

    return registry.briefing_sections(spark, d).groupBy("section_no", "section").agg(F.count("*").alias("n_stories"))


QUERIES = {
    f.__name__: f
    for f in (
        sources_by_name, source_counts, source_search, failing_feeds, articles_of_center, latest_week, known_hashes, requested_articles, title_keys, stories_by_size, unused_clusters, relative_times, source_slugs,
        upserted_sources, upserted_clusters, assigned_clusters, reanalysed, last_turns, asked_before, kept_sessions, stale_feeds, latest_payload,
        coverage_buckets, coverage_outlets, coverage_answers, compared_articles,
        bias_round_trip, json_in_text, framing_lines, key_sentences, framing_evidence, fetch_report, briefing_payload, briefing_section_counts,
    )
}

_LEANS = "['left', 'center-left', 'center', 'center-right', 'right', 'state-affiliated', 'not-applicable', 'unknown']"
_BUCKET = "CASE WHEN coalesce(bias.lean, 'unknown') <> 'unknown' THEN bias.lean ELSE coalesce(bias.source_lean, 'unknown') END"
_MIDDLE = "(SELECT (min(run_no) + max(run_no)) / 2 AS m FROM articles WHERE cluster_id <> '')"
_NOW = "(SELECT max(retrieved_at) FROM articles)"
_TURNS = "t AS (SELECT source_id AS session_id, id, CASE WHEN id % 2 = 1 THEN 'user' ELSE 'assistant' END AS role, title AS content FROM articles)"
_POLITICAL = "('left', 'center-left', 'center', 'center-right', 'right')"

ORACLES: dict[str, str] = {
    "sources_by_name": "SELECT id, name, row_number() OVER (ORDER BY lower(name), id) AS place FROM sources",
    "source_counts": "SELECT count(*) AS n_sources, count(*) FILTER (enabled) AS n_enabled FROM sources",
    "source_search": "SELECT id FROM sources WHERE enabled AND contains(lower(concat_ws(' ', name, id, lean, source_type, country, array_to_string(categories, ' '))), 'center')",
    "failing_feeds": """
        WITH f AS (SELECT DISTINCT source_id, fetched_at, status FROM raw_feeds), n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY fetched_at DESC, status DESC) AS n FROM f),
        g AS (SELECT source_id, min(n) FILTER (status <> 'error') AS good, count(*) AS c FROM n GROUP BY source_id)
        SELECT source_id, coalesce(good - 1, c) AS failures FROM g WHERE coalesce(good - 1, c) > 0 ORDER BY failures DESC, source_id LIMIT 10
    """,
    "articles_of_center": "SELECT id FROM articles WHERE source_id IN (SELECT id FROM sources WHERE lean = 'center')",
    "latest_week": f"SELECT id FROM articles WHERE retrieved_at >= {_NOW} - INTERVAL 168 HOUR",
    "known_hashes": "SELECT content_hash, min(id) AS first_id FROM articles, (SELECT max(run_no) AS last FROM articles WHERE content_hash <> '') WHERE content_hash <> '' AND run_no < last AND content_hash IN (SELECT content_hash FROM articles WHERE content_hash <> '' AND run_no = last) GROUP BY content_hash",
    "requested_articles": "SELECT -id AS place, id, title FROM articles WHERE id % 20 = 0",
    "title_keys": f"SELECT id, array_to_string(list_sort(list_distinct({toks('title', True)})), ' ') AS title_key FROM articles",
    "stories_by_size": "SELECT cluster_id, count(*) AS size FROM articles WHERE cluster_id <> '' GROUP BY cluster_id HAVING count(*) > 1",
    "unused_clusters": f"SELECT DISTINCT cluster_id FROM articles WHERE cluster_id <> '' AND cluster_id NOT IN (SELECT cluster_id FROM articles, {_MIDDLE} WHERE cluster_id <> '' AND run_no > m)",
    "relative_times": f"""
        WITH m AS (SELECT id, retrieved_at AS t, CAST(round((floor(epoch({_NOW})) - floor(epoch(retrieved_at))) / 60.0) AS BIGINT) AS m FROM articles),
        h AS (SELECT *, CAST(round(m / 60.0) AS BIGINT) AS h FROM m), x AS (SELECT *, CAST(round(h / 24.0) AS BIGINT) AS x FROM h)
        SELECT id, CASE WHEN t IS NULL THEN 'no date' WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN h < 24 THEN h || 'h ago' WHEN x < 8 THEN x || 'd ago' ELSE strftime(t AT TIME ZONE 'UTC', '%Y-%m-%d') END AS shown FROM x
    """,
    "source_slugs": "SELECT id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM sources",
    "upserted_sources": """
        SELECT id, name, lean, enabled FROM sources WHERE lean <> 'center'
        UNION ALL SELECT id, upper(name), lean, enabled FROM sources WHERE enabled AND NOT coalesce(lean <> 'center', false)
    """,
    "upserted_clusters": f"""
        WITH a AS (SELECT cluster_id, arg_min(title, id) AS key_title, count(*) AS size FROM articles, {_MIDDLE} WHERE cluster_id <> '' AND run_no <= m GROUP BY cluster_id),
        b AS (SELECT cluster_id, arg_min(title, id) AS key_title, count(*) AS size FROM articles, {_MIDDLE} WHERE cluster_id <> '' AND run_no > m GROUP BY cluster_id)
        SELECT coalesce(a.cluster_id, b.cluster_id) AS cluster_id, CASE WHEN a.cluster_id IS NOT NULL THEN a.key_title ELSE b.key_title END AS key_title, coalesce(b.size, a.size) AS size FROM a FULL JOIN b ON a.cluster_id = b.cluster_id
    """,
    "assigned_clusters": "SELECT id, CASE WHEN id % 3 = 0 THEN 'new-' || (id % 100) ELSE cluster_id END AS cluster_id FROM articles",
    "reanalysed": "SELECT id, CASE WHEN id % 5 = 0 THEN 'New: ' || title ELSE summary END AS summary FROM articles",
    "last_turns": f"WITH {_TURNS}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS n FROM t) SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY id) AS place, id, role FROM n WHERE n <= 12",
    "asked_before": f"WITH {_TURNS} SELECT session_id, max(id) AS asked_id FROM t WHERE role = 'user' AND len({toks('content', True)}) > 0 GROUP BY session_id",
    "kept_sessions": f"WITH {_TURNS} SELECT session_id, count(*) AS n_turns FROM t WHERE NOT EXISTS (SELECT 1 FROM sources s WHERE s.id = t.session_id AND NOT s.enabled) GROUP BY session_id",
    "stale_feeds": "SELECT source_id, (SELECT max(fetched_at) FROM raw_feeds) - max(fetched_at) > INTERVAL 1440 MINUTE AS is_stale FROM raw_feeds GROUP BY source_id",
    "latest_payload": "SELECT source_id, status FROM raw_feeds ORDER BY fetched_at DESC, source_id, status LIMIT 1",
    "coverage_buckets": f"""
        SELECT cluster_id, CAST(list_position({_LEANS}, lean) AS INTEGER) AS bucket_no, lean, count(*) AS n_articles, count(DISTINCT source_id) AS n_sources, count(*) FILTER (o) AS n_opinion
        FROM (SELECT cluster_id, source_id, {_BUCKET} AS lean, coalesce(bias.is_opinion, false) AS o FROM articles WHERE cluster_id <> '') GROUP BY cluster_id, lean
    """,
    "coverage_outlets": """
        WITH p AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, source_id ORDER BY retrieved_at DESC NULLS LAST, id) AS n, row_number() OVER (PARTITION BY cluster_id ORDER BY retrieved_at DESC NULLS LAST, id) AS f FROM articles WHERE cluster_id <> ''),
        q AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY f = 1 DESC, retrieved_at DESC NULLS LAST, id) AS place FROM p WHERE n = 1)
        SELECT cluster_id, place, id, source_id, f = 1 AS is_lead,
            CASE WHEN bias IS NULL THEN 'unknown' WHEN coalesce(bias.lean, 'unknown') <> 'unknown' THEN bias.lean WHEN coalesce(bias.source_lean, 'unknown') NOT IN ('unknown', 'not-applicable') THEN bias.source_lean ELSE 'unknown' END AS shown_lean,
            CASE WHEN bias IS NULL THEN 'none' WHEN coalesce(bias.lean, 'unknown') <> 'unknown' THEN 'article' WHEN coalesce(bias.source_lean, 'unknown') NOT IN ('unknown', 'not-applicable') THEN 'source' ELSE 'none' END AS basis
        FROM q WHERE place <= 12
    """,
    "coverage_answers": f"""
        WITH p AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY retrieved_at DESC NULLS LAST, id) AS n FROM articles WHERE cluster_id <> ''),
        f AS (SELECT cluster_id, n, title, source_id, source_name, {_BUCKET} AS bucket, coalesce(bias.lean, 'unknown') AS lean, coalesce(bias.lean_score, 0) AS score, coalesce(bias.is_opinion, false) AS o, coalesce(bias.framing, []) AS fr, {toks('title', True)} AS w FROM p WHERE n <= 10),
        l AS (SELECT *, list_concat(CASE WHEN o THEN ['opinion'] ELSE [] END, list_filter(fr[1:2], lambda x: NOT (o AND x = 'opinion'))) AS fl FROM f),
        b AS (SELECT cluster_id, bucket, '**Classified ' || replace(bucket, '-', ' ') || '**' || chr(10) || string_agg('- ' || coalesce(source_name, '') || ': “' || coalesce(title, '') || '”' || CASE WHEN len(fl) > 0 THEN ' (' || array_to_string(fl, ', ') || ')' ELSE '' END || ' [' || n || ']', chr(10) ORDER BY n) AS b FROM l GROUP BY cluster_id, bucket),
        bs AS (SELECT cluster_id, string_agg(b, chr(10) || chr(10) ORDER BY list_position({_LEANS}, bucket)) AS bs FROM b GROUP BY cluster_id),
        s AS (SELECT cluster_id, count(*) AS na, count(DISTINCT source_id) AS ns, CASE WHEN count(*) FILTER (lean IN {_POLITICAL}) >= 2 THEN max(score) FILTER (lean IN {_POLITICAL}) - min(score) FILTER (lean IN {_POLITICAL}) ELSE 0 END AS spread,
            list_distinct(flatten(list(w) FILTER (lean IN {_POLITICAL} AND score < -0.15))) AS lw, list_distinct(flatten(list(w) FILTER (lean IN {_POLITICAL} AND score > 0.15))) AS rw, array_to_string(list_sort(list(n)), ',') AS cited FROM f GROUP BY cluster_id),
        t AS (SELECT *, CASE WHEN rw IS NULL OR lw IS NULL THEN [] ELSE list_sort(list_filter(lw, lambda x: NOT list_contains(rw, x)))[1:8] END AS l8, CASE WHEN lw IS NULL OR rw IS NULL THEN [] ELSE list_sort(list_filter(rw, lambda x: NOT list_contains(lw, x)))[1:8] END AS r8 FROM s)
        SELECT cluster_id, concat_ws(chr(10) || chr(10), na || ' article(s) from ' || ns || ' outlet(s) cover this, grouped by an analytical classification, which is no fact:', bs,
            CASE WHEN len(l8) + len(r8) > 0 THEN '**Wording that differs between the two groups**' || chr(10) || concat_ws(chr(10), CASE WHEN len(l8) > 0 THEN '- Only in left-classified headlines: ' || array_to_string(l8, ', ') END, CASE WHEN len(r8) > 0 THEN '- Only in right-classified headlines: ' || array_to_string(r8, ', ') END) END,
            CASE WHEN ns < 3 THEN 'Note: this is a small sample; differences may come from the single articles rather than the outlets.' WHEN round(spread, 3) < 0.3 THEN 'Note: this coverage lies in a narrow band of the lean scale and is no broad cross-section.' END) AS answer, cited
        FROM t JOIN bs USING (cluster_id)
    """,
    "compared_articles": """
        WITH h AS (SELECT id, 1000000.0 - id AS score, cluster_id, canonical_url FROM articles WHERE cluster_id <> '' ORDER BY retrieved_at DESC NULLS LAST, id LIMIT 12),
        b AS (SELECT a.id, a.canonical_url, 0 AS part FROM articles a WHERE cluster_id = (SELECT cluster_id FROM h ORDER BY score DESC, id LIMIT 1) UNION ALL SELECT id, canonical_url, 1 FROM h),
        s AS (SELECT b.*, coalesce(h.score, 0) AS score, row_number() OVER (PARTITION BY coalesce(nullif(b.canonical_url, ''), CAST(b.id AS VARCHAR)) ORDER BY part, coalesce(h.score, 0) DESC, b.id) AS n FROM b LEFT JOIN h ON h.id = b.id)
        SELECT id, CAST(score AS DOUBLE) AS score, row_number() OVER (ORDER BY part, score DESC, id) AS place FROM s WHERE n = 1 ORDER BY place LIMIT 10
    """,
    "bias_round_trip": f"""
        SELECT id, CASE WHEN list_contains({_LEANS}, bias.lean) THEN bias.lean ELSE 'unknown' END AS lean, coalesce(round(bias.lean_score, 3), 0.0) AS lean_score, CASE WHEN bias.confidence IN ('low', 'medium', 'high') THEN bias.confidence ELSE 'low' END AS confidence,
            coalesce(nullif(bias.method, ''), 'heuristic') AS method, coalesce(array_to_string(bias.framing, ','), '') AS framing FROM articles
    """,
    "json_in_text": "SELECT id, CASE WHEN id % 4 <> 0 THEN source_id END AS found FROM articles",
    "framing_lines": f"""
        SELECT id, concat_ws('; ', CASE WHEN bias.lean IN {_POLITICAL} THEN 'framing classified ' || bias.lean || ' (' || coalesce(bias.confidence, 'low') || ' confidence)' WHEN bias.lean = 'not-applicable' THEN 'no political framing detected' END,
            CASE WHEN bias.is_opinion THEN 'opinion/commentary' END, CASE WHEN len(bias.framing) > 0 THEN 'markers: ' || array_to_string(bias.framing[1:4], ', ') END) AS line FROM articles
    """,
    "fetch_report": """
        SELECT '0 new, 0 updated, 0 duplicates dropped, 0 story clusters, ' || count(*) FILTER (status IN ('ok', 'not-modified')) || '/' || count(*) || ' sources ok (' || count(*) FILTER (status = 'not-modified') || ' unchanged since the last fetch, ' || count(*) FILTER (status = 'error') || ' failed)' AS report FROM raw_feeds
    """,
}
