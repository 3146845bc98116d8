"""Feed items to articles: one projection, then the newest items of each feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pressloom.functions import text as X
from pressloom.functions.urls import canonical_url

# Sizes of stored fields and the lengths at which a summary is taken for a body.
TITLE, SUMMARY, CONTENT, AUTHOR, IMAGE, LANGUAGE = 300, 2000, 12000, 160, 600, 8
BODY_FROM, SHORT = 400, 320


def tidy(text: Column) -> Column:
    """Lines joined to prose: a list item loses its marker and ends as a sentence. Null becomes empty."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))
    body = lambda x: F.regexp_replace(x, r"^[-–•*·]\s+", "")
    ended = lambda x: F.when(body(x).rlike("[.!?:;…\"'”’)]$"), body(x)).otherwise(F.concat(body(x), F.lit(".")))
    lines = F.transform(lines, lambda x: F.when(x.rlike(r"^[-–•*·]\s+\S"), ended(x)).otherwise(x))
    return X.whitespace(F.array_join(F.filter(lines, lambda x: x != ""), " "))


def articles_of(items: DataFrame) -> DataFrame:
    """Articles of feed items (source_id, title, link, summary, content, author, language, image_url, categories); other columns stay.

    Items without title or without an http(s) address are left out. Other
    missing texts become empty. A long summary without content is the content.
    """
    title = F.regexp_replace(X.whitespace(X.strip_html(F.col("title"))), r"^\[\$\]\s*", "")
    df = items.withColumns({"title": X.truncate(title, TITLE, ""), "url": F.trim(F.coalesce("link", F.lit(""))), "_s": tidy(X.strip_html(F.col("summary"))), "_c": tidy(X.strip_html(F.col("content")))})
    df = df.where((F.col("title") != "") & F.lower("url").rlike("^https?://"))
    promoted = (F.col("_c") == "") & (F.length("_s") > BODY_FROM)
    df = df.withColumns({"content": F.when(promoted, F.col("_s")).otherwise(F.col("_c")), "summary": F.when(promoted, X.truncate(F.col("_s"), SHORT)).otherwise(F.col("_s"))})
    df = df.withColumn("summary", F.when((F.col("summary") == "") & (F.col("content") != ""), X.truncate(F.col("content"), SHORT)).otherwise(F.col("summary")))
    return df.withColumns(
        {
            "canonical_url": canonical_url(F.col("url")),
            "summary": F.substring("summary", 1, SUMMARY),
            "content": F.substring("content", 1, CONTENT),
            "author": F.substring(X.whitespace(F.col("author")), 1, AUTHOR),
            "language": F.substring(F.lower(F.split(F.coalesce("language", F.lit("")), "-")[0]), 1, LANGUAGE),
            "image_url": F.substring(F.coalesce("image_url", F.lit("")), 1, IMAGE),
            "feed_categories": F.coalesce("categories", F.array().cast("array<string>")),
        }
    ).drop("_s", "_c", "link", "categories")


def newest(df: DataFrame, groups: list[str], time: Column, most: int, tie: str) -> DataFrame:
    """The ``most`` newest rows of each group, undated ones last; ties by ``tie``. Spark keeps at most ``most`` rows a group before the shuffle."""
    w = Window.partitionBy(*groups).orderBy(time.desc_nulls_last(), F.col(tie))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
