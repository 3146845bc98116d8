"""A briefing: articles ranked for a reader, one slot a story, placed in sections with limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pressloom.functions import text as X
from pressloom.operators.interests import MATCH, Interest, with_interests
from pressloom.operators.summarize import best_text
from pressloom.schemas import fields
from pressloom.session import spool

SECTIONS, PER_SECTION, TOTAL, LOOKBACK, DISTINCTIVE = 8, 5, 30, 36.0, 6


def ranked(df: DataFrame, interests: list[Interest], now: Column, time: Column, lookback: float = LOOKBACK) -> DataFrame:
    """Articles of the last ``lookback`` hours with ``rank_score``; with interests only those that match one."""
    recent = df.where(time >= F.timestamp_micros(F.unix_micros(now) - int(lookback * 3.6e9)))
    shown = [c for c in df.columns if c not in ("content", "summary")]
    df = with_interests(recent.withColumn("_size", F.length(best_text())), interests).select(*shown, "_size", "matched", "interest", "labels")
    df = spool(df, "ranked")  # scored once: the filter below would otherwise score again
    if interests:
        df = df.where(F.col("interest") >= MATCH)
    age = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(time)) / 3.6e9)
    fresh = F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), age / max(1.0, lookback)))
    opinion = F.when(F.coalesce("is_opinion", F.lit(False)), 0.12).otherwise(0.0)
    promo = F.when(F.array_contains(F.coalesce("framing", F.array().cast("array<string>")), "first-party"), 0.08).otherwise(0.0)
    dated = F.when(time.isNotNull(), 1.0).otherwise(0.4)
    return df.withColumn("rank_score", 0.50 * F.col("interest") + 0.28 * fresh + 0.12 * F.least(F.lit(1.0), F.col("_size") / 900.0) + 0.10 * dated - opinion - promo).drop("_size")


def grouped(df: DataFrame, id_col: str = "id") -> DataFrame:
    """One row a story (cluster_id, else the article): its best article's columns, n_members, n_sources, group_score with up to 0.22 for other outlets.

    The lead is taken by ``max_by``, so no story is gathered.
    """
    key = F.when(F.coalesce("cluster_id", F.lit("")) != "", F.col("cluster_id")).otherwise(F.concat(F.lit("solo:"), F.col(id_col).cast("string")))
    lead = F.struct(*df.columns)
    out = df.withColumn("story_key", key).groupBy("story_key").agg(F.max_by(lead, F.struct("rank_score", (-F.col(id_col)).alias("i"))).alias("lead"), F.count("*").alias("n_members"), F.countDistinct("source_id").alias("n_sources"))
    return out.select("story_key", "lead.*", "n_members", "n_sources", (F.col("lead.rank_score") + F.least(F.lit(0.22), 0.08 * (F.col("n_sources") - 1))).alias("group_score"))


def sections(stories: DataFrame, interests: list[Interest], id_col: str = "id", pool: int = 2000) -> DataFrame:
    """(section_no, section, place, id, group_score): stories in order, each in its best section with room; one event, one slot.

    Placing is sequential over the best ``pool`` stories, a limit of the feature;
    they are folded in one task. Words in at most six of the pool's headlines
    tell events apart.
    """
    top = stories.orderBy(F.desc("group_score"), id_col).limit(pool)
    words = F.array_distinct(X.tokens(F.col("title")))
    top = top.select(F.col(id_col).alias("id"), "group_score", "source_id", "canonical_url", words.alias("words"), F.get("topics", F.lit(0)).alias("topic"), F.col("labels"))
    order = [i.label for i in interests]
    per_source = max(2, PER_SECTION // 2)

    def place(pdf):
        import pandas as pd

        seen: dict[str, int] = {}
        for ws in pdf["words"]:
            for w in ws:
                seen[w] = seen.get(w, 0) + 1
        rare = {w for w, n in seen.items() if n <= DISTINCTIVE and len(w) >= 4 and not w.isdigit()}
        rooms: dict[str, list] = {}
        held: dict[tuple[str, str], int] = {}
        used, events, total = set(), [], 0
        for r in pdf.sort_values(["group_score", "id"], ascending=[False, True]).itertuples():
            head = set(r.words)
            if total >= TOTAL:
                break
            if (r.canonical_url or r.id) in used or any(len(head & e) >= 2 and head & e & rare for e in events):
                continue
            wanted = list(r.labels) if order else [str(r.topic or "general").replace("-", " ").title()]
            room = next((x for x in wanted if len(rooms.get(x, ())) < PER_SECTION and held.get((x, r.source_id), 0) < per_source), None)
            if room is None:
                continue
            rooms.setdefault(room, []).append((r.id, r.group_score))
            held[room, r.source_id] = held.get((room, r.source_id), 0) + 1
            used.add(r.canonical_url or r.id)
            events.append(head)
            total += 1
        ranks = sorted(rooms, key=lambda x: (order.index(x) if x in order else len(order) + 1, -sum(s for _, s in rooms[x]), x))[:SECTIONS]
        rows = [(n, x, k, i, s) for n, x in enumerate(ranks, 1) for k, (i, s) in enumerate(rooms[x], 1)]
        return pd.DataFrame(rows, columns=["section_no", "section", "place", "id", "group_score"])

    return top.groupBy().applyInPandas(place, fields("section_no int, section string, place int, id long, group_score double"))


def first_per_outlet(df: DataFrame, group: str, lead: Column, order: Column, most: int = 12) -> DataFrame:
    """One row an outlet and story, the lead's first, at most ``most`` a story."""
    one = Window.partitionBy(group, "source_id").orderBy(lead.desc(), order)
    rest = Window.partitionBy(group).orderBy(lead.desc(), order)
    return df.withColumn("_n", F.row_number().over(one)).where("_n = 1").withColumn("_n", F.row_number().over(rest)).where(F.col("_n") <= most).drop("_n")
