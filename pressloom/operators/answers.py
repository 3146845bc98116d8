"""Citations of an answer, and answers put together from retrieved rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def citations(text: Column, n_sources: Column) -> Column:
    """(text without wrong citations, valid numbers sorted, wrong marks): ``[n]`` is right for n from 1 to ``n_sources``."""
    text = F.coalesce(text, F.lit(""))
    marks = F.regexp_extract_all(text, F.lit(r"\[(\d{1,2})\]"), F.lit(1))
    good = lambda m: m.cast("int").between(1, n_sources)
    wrong = F.array_distinct(F.filter(marks, lambda m: ~good(m)))
    clean = F.aggregate(wrong, text, lambda t, m: F.replace(t, F.concat(F.lit("["), m, F.lit("]")), F.lit("")))
    clean = F.trim(F.regexp_replace(F.regexp_replace(clean, r"[ \t]{2,}", " "), r" +([.,;:!?])", "$1"))
    valid = F.array_sort(F.array_distinct(F.transform(F.filter(marks, good), lambda m: m.cast("int"))))
    return F.struct(clean.alias("text"), valid.alias("valid"), F.transform(wrong, lambda m: F.concat(F.lit("["), m, F.lit("]"))).alias("invalid"))


def without_thoughts(text: Column) -> Column:
    """A completion without its thinking block."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?is)<(think|thinking|reasoning)>.*?</\1>", ""))


def extractive_answer(stories: DataFrame, question: str) -> DataFrame:
    """One row: question, answer and the cited numbers, from (place, title, source_name, published, brief, outlets).

    No rows give the fixed answer that nothing was found; nothing is invented.
    """
    line = F.concat_ws(" ", F.concat(F.lit("["), F.col("place").cast("string"), F.lit("]")), F.col("title"), F.concat(F.lit("("), F.coalesce("source_name", F.lit("")), F.lit(")")), F.col("brief"),
                       F.when(F.size("outlets") > 0, F.concat(F.lit("Also: "), F.array_join(F.slice("outlets", 1, 4), ", "))))
    rows = stories.agg(F.array_sort(F.collect_list(F.struct("place", line.alias("t")))).alias("r"))  # the few stories of one answer
    body = F.array_join(F.transform("r", lambda x: x["t"]), "\n")
    return rows.select(F.lit(question).alias("question"), F.when(F.size("r") == 0, F.lit("No stored article covers this.")).otherwise(body).alias("answer"), F.transform("r", lambda x: x["place"]).alias("cited"))
