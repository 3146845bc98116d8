"""How outlets cover one story: buckets by lean, one row an outlet, and the comparison as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pressloom.functions import text as X
from pressloom.operators import framing
from pressloom.operators.briefing import first_per_outlet

MOST_OUTLETS, MOST_COMPARED, NARROW, SMALL = 12, 10, 0.3, 3


def bucket(bias: Column) -> Column:
    """The lean a row is filed under: the article's own, else its source's."""
    lean = F.coalesce(bias["lean"], F.lit("unknown"))
    return F.when(lean != "unknown", lean).otherwise(F.coalesce(bias["source_lean"], F.lit("unknown")))


def bucket_no(lean: Column) -> Column:
    """The place of a lean in the fixed order, from 1; others come last."""
    place = F.array_position(F.array(*map(F.lit, framing.BUCKETS)), lean)
    return F.when(place > 0, place).otherwise(len(framing.BUCKETS) + 1).cast("int")


def buckets(df: DataFrame, group: str) -> DataFrame:
    """(group, bucket_no, lean, n_articles, n_sources, n_opinion) of the articles with a group. Null and blank groups are left out."""
    rows = df.where(F.coalesce(group, F.lit("")) != "").select(group, "source_id", bucket(F.col("bias")).alias("lean"), F.coalesce("bias.is_opinion", F.lit(False)).alias("o"))
    out = rows.groupBy(group, "lean").agg(F.count("*").alias("n_articles"), F.countDistinct("source_id").alias("n_sources"), F.count_if("o").alias("n_opinion"))
    return out.select(group, bucket_no(F.col("lean")).alias("bucket_no"), "lean", "n_articles", "n_sources", "n_opinion")


def outlets(df: DataFrame, group: str, time: str, id_col: str = "id", most: int = MOST_OUTLETS) -> DataFrame:
    """(group, place, id, source_id, is_lead, shown_lean, basis): one row an outlet of each story, the newest article's outlet first, at most ``most``.

    Each outlet is reduced to one row by an aggregate before places are given, so
    no window sees more rows than there are outlets.
    """
    rows = df.where(F.coalesce(group, F.lit("")) != "").select(group, F.col(id_col).alias("id"), "source_id", F.col(time).alias("t"), framing.badge(F.col("bias")).alias("badge"))
    newest = F.max(F.struct("t", (-F.col("id")).alias("i"), "badge"))
    per = rows.groupBy(group, "source_id").agg(newest.alias("m")).select(group, "source_id", F.col("m.t").alias("t"), (-F.col("m.i")).alias("id"), "m.badge")
    lead = per.groupBy(F.col(group).alias("_g")).agg(F.max(F.struct("t", (-F.col("id")).alias("i"))).alias("top"))
    marked = per.join(lead, F.col(group) == F.col("_g")).withColumn("is_lead", F.col("id") == -F.col("top.i"))
    shown = first_per_outlet(marked, group, F.col("is_lead"), F.struct((-F.unix_micros("t")).alias("t"), "id"), most)
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("is_lead"), F.desc_nulls_last("t"), "id"))
    return shown.select(group, place.alias("place"), "id", "source_id", "is_lead", F.col("badge.lean").alias("shown_lean"), F.col("badge.basis").alias("basis"))


def compared(hits: DataFrame, members: DataFrame, most: int = MOST_COMPARED) -> DataFrame:
    """(id, score, place) to compare: all articles of the best hit's cluster, then the other hits, the first of each address; what wasn't a hit has score 0.

    ``hits``: id, score, cluster_id, canonical_url. ``members``: the same columns
    but score, of all articles. At most ``most`` rows.
    """
    first = hits.orderBy(F.desc("score"), "id").limit(1).select(F.col("cluster_id").alias("_c"))
    of_lead = members.join(F.broadcast(first.where("_c <> ''")), F.col("cluster_id") == F.col("_c")).select("id", "canonical_url", F.lit(0).alias("part"))  # one row
    both = of_lead.unionByName(hits.select("id", "canonical_url", F.lit(1).alias("part")))
    scored = both.join(hits.select(F.col("id").alias("_i"), "score"), F.col("id") == F.col("_i"), "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    key = F.coalesce(F.nullif("canonical_url", F.lit("")), F.col("id").cast("string"))
    once = scored.groupBy(key.alias("k")).agg(F.min(F.struct("part", (-F.col("score")).alias("s"), "id")).alias("m"))
    few = once.orderBy("m.part", "m.s", "m.id").limit(most)  # a limit of the feature: the rows below are at most ``most``
    place = F.row_number().over(Window.orderBy("m.part", "m.s", "m.id"))
    return few.select(F.col("m.id").alias("id"), (-F.col("m.s")).alias("score"), place.alias("place"))


def answers(df: DataFrame, group: str, time: str, id_col: str = "id", most: int = MOST_COMPARED) -> DataFrame:
    """(group, answer, cited): the comparison of each story as text, without a model: what was published, filed by lean, and the words that only one side's headlines have.

    The ``most`` newest articles of a story are numbered and shown, a limit of
    the feature, applied before anything is gathered.
    """
    rows = df.where(F.coalesce(group, F.lit("")) != "")
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last(time), id_col)
    few = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    few = few.select(
        group, "n", "title", "source_id", "source_name", bucket(F.col("bias")).alias("bucket"), F.coalesce("bias.lean", F.lit("unknown")).alias("lean"), F.coalesce("bias.lean_score", F.lit(0.0)).alias("lean_score"),
        F.coalesce("bias.is_opinion", F.lit(False)).alias("is_opinion"), F.coalesce("bias.framing", F.array().cast("array<string>")).alias("framing"),
    )
    flags = F.array_distinct(F.concat(F.when(F.col("is_opinion"), F.array(F.lit("opinion"))).otherwise(F.array().cast("array<string>")), F.slice("framing", 1, 2)))
    suffix = F.when(F.size(flags) > 0, F.concat(F.lit(" ("), F.array_join(flags, ", "), F.lit(")"))).otherwise("")
    line = F.concat(F.lit("- "), F.coalesce("source_name", F.lit("")), F.lit(": “"), F.coalesce("title", F.lit("")), F.lit("”"), suffix, F.lit(" ["), F.col("n").cast("string"), F.lit("]"))
    part = few.groupBy(group, "bucket").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("ls"))  # at most ``most``
    block = F.concat(F.lit("**Classified "), F.replace(F.col("bucket"), F.lit("-"), F.lit(" ")), F.lit("**\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n"))
    blocks = part.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(bucket_no(F.col("bucket")).alias("k"), block.alias("b")))), lambda x: x["b"]), "\n\n").alias("blocks"))
    facts = framing.coverage(few, group)
    words = lambda c: F.array_join(F.slice(c, 1, 8), ", ")
    wording = F.array_join(
        F.array_compact(
            F.array(
                F.when(F.size("left_terms") > 0, F.concat(F.lit("- Only in left-classified headlines: "), words("left_terms"))), F.when(F.size("right_terms") > 0, F.concat(F.lit("- Only in right-classified headlines: "), words("right_terms")))
            )
        ),
        "\n",
    )
    note = F.when(F.col("n_sources") < SMALL, "Note: this is a small sample; differences may come from the single articles rather than the outlets.").when(
        F.col("lean_spread") < NARROW, "Note: this coverage lies in a narrow band of the lean scale and is no broad cross-section."
    )
    head = F.format_string("%d article(s) from %d outlet(s) cover this, grouped by an analytical classification, which is no fact:", "n_articles", "n_sources")
    whole = F.concat_ws("\n\n", head, "blocks", F.when(wording != "", F.concat(F.lit("**Wording that differs between the two groups**\n"), wording)), note)
    cited = few.groupBy(group).agg(F.array_sort(F.collect_set("n")).alias("cited"))
    return facts.join(blocks, group).join(cited, group).select(group, whole.alias("answer"), "cited")


def citation_rows(df: DataFrame, time: str) -> DataFrame:
    """``df`` (id, score and article columns) as citable sources: number, texts cut for show, badge, at most eight entities, score to four places."""
    b = framing.badge(F.col("bias"))
    place = F.row_number().over(Window.orderBy(F.desc("score"), "id"))  # a question has at most 120 rows
    brief = X.truncate(F.when(F.coalesce("summary", F.lit("")) != "", F.col("summary")).otherwise(F.coalesce("content", F.lit(""))), 320)
    return df.select(
        place.alias("n"), "id", "title", F.col("source_name").alias("source"), "source_id", F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss").alias("published"), brief.alias("summary"),
        F.slice(F.coalesce("entities", F.array().cast("array<string>")), 1, 8).alias("entities"), b["lean"].alias("shown_lean"), b["basis"].alias("basis"), F.round("score", 4).alias("score"),
    )
