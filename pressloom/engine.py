"""The whole as one object over a folder of tables: refresh, ask, compare, briefing, status."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.functions import text as X
from pressloom.operators import answers, briefing, cluster, comparison, dedupe, framing, interests, normalize, reports, state, store, summarize, timestamps, topics
from pressloom.schemas import fields
from pressloom.search import question, ranking
from pressloom.session import scratch, spool
from pressloom.settings import Preferences, Settings
from pressloom.sources import feeds, fetch, registry

log = logging.getLogger("pressloom")
ARTICLE = ["id", "canonical_url", "url", "title", "source_id", "source_name", "summary", "content", "author", "published_at", "retrieved_at", "language", "image_url", "feed_categories", "topics", "entities", "content_hash", "simhash", "cluster_id", "bias"]
STATE = fields("source_id string, last_fetch timestamp, last_success timestamp, etag string, last_modified string, error string, failures long")
TURNS = fields("session_id string, id long, role string, content string, batch string")


def _tidied(step: Callable) -> Callable:
    """A method whose spooled tables are deleted when it is done; its results are values."""

    @wraps(step)
    def run(self, *given, **named):
        with scratch(self.spark):
            return step(self, *given, **named)

    return run


@dataclass
class Engine:
    """All state lies in ``folder``; ``now`` is always given, so a run can be repeated."""

    spark: SparkSession
    folder: str
    settings: Settings = Settings()
    lexicon: dict[str, list[str]] | None = None

    def _path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}"

    def _table(self, name: str, schema=None) -> DataFrame:
        """A stored table; with a schema an empty one where nothing is stored yet."""
        try:
            return store.current(self.spark, self._path(name))
        except Exception:  # noqa: BLE001 nothing is stored yet
            if schema is None:
                raise
            return self.spark.createDataFrame([], schema)

    def sync_registry(self, path: str) -> str | None:
        """Read a registry into the table of sources. A broken registry is reported, and the stored sources stay."""
        try:
            new = registry.load_registry(self.spark, path)
        except registry.RegistryError as why:
            log.warning("registry: %s", why)
            return str(why)
        store.replaced(store.upserted_sources(self._table("sources", registry.SOURCES), new), self._path("sources"))
        return None

    @_tidied
    def refresh(self, now: datetime, fetcher: fetch.Fetcher = fetch.over_http, only: list[str] | None = None) -> dict:
        """One run of ingest: fetch, parse, normalise, drop duplicates, upsert, cluster the last hours again, forget what is old. Returns the counters and their line.

        Every table is written beside the old one and then named current; a run
        that fails changes nothing it hasn't finished, and running it again with
        the same answers changes nothing more.
        """
        when, s = F.lit(now).cast("timestamp"), self.settings
        sources, known = self._table("sources"), self._table("feed_state", STATE)
        due = state.due_feeds(sources, known.select("source_id", "failures"), s.failures_allowed)
        due = due.where(F.col("id").isin(only)) if only else due
        fetched = spool(fetch.fetch(due.select("id", "url"), known, fetcher).withColumn("fetched_at", when), "fetched")
        counts = reports.fetch_counts(fetched).first().asDict()
        store.replaced(spool(self._next_state(known, fetched, when), "state"), self._path("feed_state"))
        items = feeds.feed_items(fetched.where("status = 'ok'").select("source_id", "fetched_at", "body")).where("error is null")
        dated = timestamps.normalise(normalize.articles_of(items).withColumnRenamed("published", "written"), self.spark.createDataFrame([], "source_id string, clock_zone string, day_first boolean"))
        new = spool(self._analysed(dated.withColumn("published_at", F.timestamp_seconds("utc_second")), sources, when), "new")
        new = normalize.newest(new, ["source_id"], F.col("published_at"), s.per_feed, "row")
        kept = spool(new.join(dedupe.exact_kept(new, "row").select(F.col("kept_id").alias("row")), "row", "left_semi"), "kept")
        near = dedupe.first_kept(kept.select(F.col("row").alias("id")), dedupe.near_pairs(kept, "row", "source_id", "title", "summary"))
        fresh = spool(kept.join(near.where("id = kept_id").select(F.col("id").alias("row")), "row", "left_semi").drop("row"), "fresh")
        old = self._table("articles", fresh.schema)
        merged = spool(state.upsert_articles(old, fresh), "merged")
        changes = {r["change"]: r["count"] for r in merged.groupBy("change").count().collect()}
        stories = cluster.recluster(merged.drop("change"), "id", "title", "entities", F.col("retrieved_at"), when, lookback=s.recluster)
        placed = store.with_clusters(merged.drop("change"), stories.where("size > 1").select("id", "cluster_id"))
        live = store.replaced(spool(state.retained(placed, F.coalesce("published_at", "retrieved_at"), when, s.retention_days), "live"), self._path("articles"))
        counts |= {
            "entries": items.count(), "inserted": changes.get("inserted", 0), "updated": changes.get("updated", 0), "duplicates": new.count() - fresh.count(),
            "clusters": live.where("cluster_id <> ''").groupBy("cluster_id").count().where("count > 1").count(), "pruned": merged.count() - live.count(),
        }
        names = ("inserted", "updated", "duplicates", "clusters", "sources_ok", "sources_not_modified", "sources_failed", "sources_total")
        counts["report"] = self.spark.range(1).select(reports.report_line(*[F.lit(counts[n]).cast("long") for n in names])).first()[0]
        log.info(counts["report"])
        return counts

    def _next_state(self, known: DataFrame, fetched: DataFrame, when: Column) -> DataFrame:
        """Feed states after a run: a success resets the failures, a null etag or time keeps the known one."""
        k, f = known.alias("k"), fetched.alias("f")
        both = k.join(f, F.col("k.source_id") == F.col("f.source_id"), "full_outer")
        seen, good = F.col("f.source_id").isNotNull(), F.col("f.status") != "error"
        failures = F.coalesce("k.failures", F.lit(0).cast("long"))
        return both.select(
            F.coalesce("k.source_id", "f.source_id").alias("source_id"), F.when(seen, when).otherwise(F.col("k.last_fetch")).alias("last_fetch"), F.when(seen & good, when).otherwise(F.col("k.last_success")).alias("last_success"),
            F.coalesce("f.etag", "k.etag").alias("etag"), F.coalesce("f.last_modified", "k.last_modified").alias("last_modified"), F.when(seen, F.col("f.error")).otherwise(F.col("k.error")).alias("error"),
            F.when(~seen, failures).when(good, F.lit(0).cast("long")).otherwise(failures + 1).alias("failures"),
        )

    def _analysed(self, rows: DataFrame, sources: DataFrame, when: Column) -> DataFrame:
        """Articles with ids, hashes, entities, topics and framing."""
        dim = F.broadcast(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("lean").alias("source_lean"), F.col("confidence").alias("source_confidence"), "source_type", F.col("categories").alias("source_categories")))  # the registry is small
        both = F.concat_ws(". ", "title", "summary")
        df = rows.join(dim, "source_id", "left").withColumns(
            {
                "row": F.xxhash64("source_id", "url", "title", "content", "summary"), "id": F.xxhash64("canonical_url").bitwiseAND((1 << 62) - 1), "retrieved_at": when, "content_hash": X.content_hash(F.col("title"), F.col("canonical_url")), "entities": X.entities(both),
                "simhash": X.simhash(X.tokens(F.concat_ws(" ", "title", "summary"))), "cluster_id": F.lit(""),
            }
        )
        out = reports.with_rationale(framing.assess(topics.with_topics(df, self.lexicon, hints=True).drop("topic_scores")))
        verdict = F.struct("lean", "lean_score", "confidence", "subjectivity", "is_opinion", "framing", "signals", F.lit("heuristic").alias("method"), "rationale", F.coalesce("source_lean", F.lit("unknown")).alias("source_lean"))
        return out.withColumn("bias", verdict).select("row", *ARTICLE).dropDuplicates(["row"])

    @_tidied
    def reanalyse(self) -> None:
        """Topics of all stored articles by the present lexicon."""
        rows = self._table("articles")
        new = topics.with_topics(rows.drop("topics"), self.lexicon).select("id", "topics")
        store.replaced(spool(store.with_analysis(rows, new), "articles"), self._path("articles"))

    @_tidied
    def ask(self, text: str, now: datetime, session: str | None = None) -> dict:
        """Answer a question from stored articles, with its sources; the turn is remembered in its session. A comparison of coverage looks at the whole story."""
        session, when = session or store.session_id(), F.lit(now).cast("timestamp")
        turns = self.turns(session)
        q = question.parse(self.spark, text, [{"role": r["role"], "content": r["content"]} for r in turns], self.lexicon or topics.lexicon())
        rows = self._table("articles")
        found = spool(ranking.diversified(hits := spool(ranking.retrieve(rows, q, when, "retrieved_at"), "hits"), self.settings.answers).join(hits, "id"), "found")
        if q.intent == "compare_coverage" and not found.isEmpty():
            of_story = comparison.compared(found.select("id", "score", "cluster_id", "canonical_url"), rows.select("id", "cluster_id", "canonical_url"))
            picked = rows.join(F.broadcast(of_story.select("id")), "id").withColumn("_all", F.lit("q"))  # at most ten rows
            out = comparison.answers(picked, "_all", "retrieved_at").first()
        else:
            briefs = summarize.summaries(found, "id")
            stories = found.join(briefs, "id").select((F.col("place") + 1).alias("place"), "title", "source_name", "brief", F.array().cast("array<string>").alias("outlets"))
            out = answers.extractive_answer(stories, text).first()
        shown = [r.asDict() for r in comparison.citation_rows(found, "retrieved_at").orderBy("n").collect()]  # at most ``answers`` rows
        self._remember(session, len(turns), text, out["answer"])
        return {"session": session, "intent": q.intent, "answer": out["answer"], "cited": list(out["cited"]), "sources": shown}

    def turns(self, session: str) -> list:
        """The last turns of a session."""
        return store.last_turns(self._turns().where(F.col("session_id") == session), self.settings.history_turns).orderBy("id").collect()

    def _turns(self) -> DataFrame:
        try:
            return self.spark.read.schema(TURNS).parquet(self._path("turns"))
        except Exception:  # noqa: BLE001 nobody has asked yet
            return self.spark.createDataFrame([], TURNS)

    def _remember(self, session: str, before: int, asked: str, said: str) -> None:
        """Store a turn; a failure to do so is logged and doesn't fail the answer."""
        try:
            at = int(datetime.now().timestamp() * 1e6)
            store.append_rows(self.spark.createDataFrame([(session, at, "user", asked), (session, at + 1, "assistant", said)], "session_id string, id long, role string, content string"), self._path("turns"), uuid.uuid4().hex)
        except Exception:  # noqa: BLE001
            log.exception("turn not stored")

    @_tidied
    def forget(self, session: str) -> None:
        """Delete a session."""
        left = spool(store.without_sessions(self._turns().drop("batch"), self.spark.createDataFrame([(session,)], "session_id string")), "turns")
        left.write.mode("overwrite").parquet(self._path("turns"))

    @_tidied
    def briefing(self, now: datetime) -> dict:
        """Make and store a briefing for the stored preferences; the newest ``briefings_kept`` stay."""
        when, s = F.lit(now).cast("timestamp"), self.settings
        who = interests.parse_interests(Preferences.load(self._path("preferences.json")).interests, self.lexicon)
        rows = self._table("articles")
        pool = rows.where(F.col("retrieved_at") >= F.timestamp_micros(F.unix_micros(when) - int(s.lookback * 3.6e9)))
        flat = pool.withColumns({"is_opinion": F.col("bias.is_opinion"), "framing": F.col("bias.framing")})
        placed = spool(briefing.sections(briefing.grouped(briefing.ranked(flat, who, when, F.col("retrieved_at"), s.lookback)), who), "placed")
        picked = rows.join(F.broadcast(placed), "id")  # at most thirty rows
        briefs = summarize.summaries(picked, "id").select("id", F.col("brief").alias("summary"))
        outlets = rows.where("cluster_id <> ''").groupBy("cluster_id").agg(F.countDistinct("source_id").alias("n"))
        stories = picked.drop("summary").join(briefs, "id").join(outlets, "cluster_id", "left").withColumn("source_count", F.coalesce("n", F.lit(1)))
        made = reports.payload(stories, when, [i.label for i in who], pool.select("id"), s.lookback)
        old = self._table("briefings", made.schema)
        kept = spool(old.unionByName(made).orderBy(F.desc("generated_at")).limit(s.briefings_kept), "briefings")
        store.replaced(kept, self._path("briefings"))
        return self.latest_briefing()

    def latest_briefing(self) -> dict | None:
        """The newest stored briefing, or None."""
        try:
            row = store.latest(self._table("briefings"), [F.desc("generated_at")]).first()
        except Exception:  # noqa: BLE001 none is stored yet
            return None
        return row.asDict() if row else None

    def status(self, now: datetime) -> dict:
        """Articles, sources, failing feeds, and whether the briefing is stale."""
        when = F.lit(now).cast("timestamp")
        who = Preferences.load(self._path("preferences.json"))
        sources, feeds_ = self._table("sources", registry.SOURCES), self._table("feed_state", STATE)
        rows = self._table("articles", "source_id string, retrieved_at timestamp")
        last = self.latest_briefing()
        stale = last is None or self.spark.range(1).select(store.is_stale(F.lit(last["generated_at"]), when, self.settings.briefing_minutes)).first()[0]
        failing = feeds_.where("failures > 0").orderBy(F.desc("failures"), "source_id").limit(10)
        return state.stats(rows, when, "retrieved_at").first().asDict() | {
            "sources_total": sources.count(), "sources_enabled": sources.where("enabled").count(), "failing": [r.asDict() for r in failing.select("source_id", "failures", "error").collect()],
            "onboarded": who.onboarded, "interests": who.interests, "briefing_stale": bool(stale),
        }
