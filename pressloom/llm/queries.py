"""Queries of the training-data operators over the test tables, at production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.llm import boilerplate, caps, encoding, history, leakage, mixture, neardup, pii, truncation
from pressloom.session import shared_dir
from pressloom.sources.tables import table


def article_text(spark: SparkSession, d: str) -> DataFrame:
    """(id, text): title, summary and content joined by spaces, null as empty."""
    parts = [F.coalesce(c, F.lit("")) for c in ("title", "summary", "content")]
    return table(spark, d, "articles").select("id", F.concat_ws(" ", *parts).alias("text"))


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled(table(spark, d, "articles", "id", "title", "content"), "id", ["title", "content"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select(F.col("id").alias("article_id"), "field_name")


def p6_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled fields with their restored text, the mapping that was undone, and whether characters are lost."""
    return _garbled(spark, d).withColumnRenamed("id", "article_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    members, links = neardup.similar(article_text(spark, d), "id", "text", size=3, threshold=0.5, bands=84)
    return neardup.all_pairs(members, links)


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per article: its class of equal texts, its group of near-duplicates, its number of links."""
    return neardup.groups(article_text(spark, d), "id", "text")


def _ranked_articles(spark: SparkSession, d: str) -> DataFrame:
    quality = table(spark, d, "article_quality", "article_id", "quality")
    return table(spark, d, "articles", "id", "run_no", "source_id", "author").join(quality.withColumnRenamed("article_id", "id"), "id", "left")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The articles over the share of their outlet in their run."""
    rows = _ranked_articles(spark, d).select("id", "run_no", "source_id", "quality")
    out = caps.within_caps(rows, "id", "quality", [caps.Level(("run_no", "source_id"), share=0.05, scope=("run_no",))])
    return out.where("not kept").select(F.col("id").alias("article_id"))


def p2_nested_caps(spark: SparkSession, d: str) -> DataFrame:
    """Nested limits of a run: three articles an author and outlet, a twentieth an outlet, a tenth an owner."""
    owners = table(spark, d, "sources", "id", "ownership").select(F.col("id").alias("source_id"), F.when(F.trim("ownership") != "", F.col("ownership")).alias("owner"))
    rows = _ranked_articles(spark, d).join(owners, "source_id", "left")
    levels = [
        caps.Level(("run_no", "source_id", "author"), most=3, free="author"),
        caps.Level(("run_no", "source_id"), share=0.05, scope=("run_no",)),
        caps.Level(("run_no", "owner"), share=0.1, scope=("run_no",), free="owner"),
    ]
    out = caps.within_caps(rows, "id", "quality", levels)
    return out.select(F.col("id").alias("article_id"), "kept", "level")


def _cuts(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "articles", "id", "source_id", "title", "summary", "content"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _cuts(spark, d).where("is_cut").select("article_id", "field_name")


def p3_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why each cut text counts as cut: an omission mark, something broken or open at its end, a field limit, or an end where no text stops."""
    return _cuts(spark, d).where("is_cut").groupBy("source_id", "field_name", "reason").agg(F.count("*").alias("n_texts"))


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts summaries and contents."""
    return truncation.rates(_cuts(spark, d))


def _history(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """The articles, and the folder of a new index."""
    return table(spark, d, "articles", "id", "run_no", "canonical_url", "content_hash", "title"), f"{shared_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return history.repeats(*_history(spark, d))


def p4_last_run(spark: SparkSession, d: str) -> DataFrame:
    """The newest run against a stored index of all earlier runs."""
    return history.last_run_against_history(*_history(spark, d))


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    """One row an article: how many of earlier runs it repeats, by address, hash, title and similar title."""
    return history.earlier_counts(*_history(spark, d)).drop("title_class")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles", "id", "source_id", "content")
    out = boilerplate.repeated_lines(rows, "id", "source_id", "content", least=5, exact=True)
    return out.select(F.col("id").alias("article_id"), "line_no")


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    """All articles with the lines of frequent near-duplicate clusters removed."""
    rows = table(spark, d, "articles", "id", "source_id", "content")
    return boilerplate.without_repeated_lines(rows, "id", "source_id", "content").withColumnRenamed("id", "article_id")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items", "item_id", "item_text")
    return leakage.leaks(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", items, "item_id", "item_text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Twelve words in a row of an item: the windows that the search found at distance 0."""
    return _leaks(spark, d).where("distance = 0").select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Leaks within two word edits of a window of twelve words."""
    return _leaks(spark, d)


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Which items leaked, into how many documents."""
    return leakage.report(_leaks(spark, d))


TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
LANGUAGES = {"lang": {"en": 0.5, "de": 0.15, "fr": 0.15, "es": 0.1, "pt": 0.05, "ru": 0.05}}


def _mixed(spark: SparkSession, d: str, marginals: dict | None = None) -> DataFrame:
    return mixture.mixture(table(spark, d, "documents", "doc_id", "source", "lang", "text"), table(spark, d, "mix_targets"), TOKENIZER, marginals=marginals)


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """How often each document of the target sources is used."""
    return _mixed(spark, d)


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source."""
    return mixture.report(_mixed(spark, d), table(spark, d, "mix_targets"))


def p9_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source, language and topic, when languages have targets too."""
    return mixture.gaps(_mixed(spark, d, LANGUAGES), table(spark, d, "mix_targets"), LANGUAGES)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.occurrences(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text").select("doc_id", "pii_kind", "start_pos")


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    """All documents with typed placeholders."""
    return pii.redacted(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p2_found, p2_nested_caps, p3_found, p3_rates, p3_reasons, p4_found, p4_last_run, p4_links, p5_found, p5_clean, p6_found, p6_restored, p7_found, p7_groups, p8_found, p8_leaks, p8_report, p9_mixture, p9_report, p9_gaps, p10_found, p10_redacted)}

_TITLE_WORDS = "list_distinct(list_filter(regexp_extract_all(lower(coalesce(title, '')), '[\\p{L}\\p{N}]+'), lambda x: x <> ''))"

ORACLES: dict[str, str] = {
    "p2_found": """
        SELECT id AS article_id FROM (
            SELECT a.id, row_number() OVER (PARTITION BY a.run_no, a.source_id ORDER BY q.quality DESC NULLS LAST, a.id) AS place,
                   count(*) OVER (PARTITION BY a.run_no) AS size
            FROM articles a LEFT JOIN article_quality q ON q.article_id = a.id)
        WHERE place > ceil(size * 0.05 - 1e-9)
    """,
    "p4_found": f"""
        WITH t AS (SELECT id, run_no, canonical_url, content_hash, {_TITLE_WORDS} AS w FROM articles),
        e AS (SELECT id, run_no, len(w) AS n, unnest(w) AS word FROM t),
        near AS (
            SELECT x.id AS earlier_id, y.id AS later_id FROM e x JOIN e y ON x.word = y.word AND x.run_no < y.run_no
            GROUP BY x.id, y.id, x.n, y.n HAVING count(*) / (x.n + y.n - count(*)) >= 0.6)
        SELECT earlier_id, later_id FROM near
        UNION SELECT x.id, y.id FROM t x JOIN t y ON trim(x.canonical_url) <> '' AND x.canonical_url = y.canonical_url AND x.run_no < y.run_no
        UNION SELECT x.id, y.id FROM t x JOIN t y ON trim(x.content_hash) <> '' AND x.content_hash = y.content_hash AND x.run_no < y.run_no
    """,
    "p4_last_run": f"""
        WITH t AS (SELECT id, run_no, canonical_url, content_hash, {_TITLE_WORDS} AS w FROM articles),
        n AS (SELECT * FROM t WHERE run_no = (SELECT max(run_no) FROM t)), o AS (SELECT * FROM t WHERE run_no < (SELECT max(run_no) FROM t)),
        e AS (SELECT id, len(w) AS n, unnest(w) AS word FROM o), f AS (SELECT id, len(w) AS n, unnest(w) AS word FROM n)
        SELECT x.id AS earlier_id, y.id AS later_id FROM e x JOIN f y USING (word) GROUP BY x.id, y.id, x.n, y.n HAVING count(*) / (x.n + y.n - count(*)) >= 0.6
        UNION SELECT x.id, y.id FROM o x JOIN n y ON trim(x.canonical_url) <> '' AND x.canonical_url = y.canonical_url
        UNION SELECT x.id, y.id FROM o x JOIN n y ON trim(x.content_hash) <> '' AND x.content_hash = y.content_hash
    """,
    "p4_links": f"""
        WITH t AS (SELECT id, run_no, canonical_url, content_hash, list_sort({_TITLE_WORDS}) AS w FROM articles),
        e AS (SELECT id, run_no, w, unnest(w) AS word FROM t),
        near AS (SELECT y.id, count(*) AS n FROM (
            SELECT x.id AS o, y.id FROM e x JOIN e y ON x.word = y.word AND x.run_no < y.run_no AND x.w <> y.w
            GROUP BY x.id, y.id, x.w, y.w HAVING count(*) / (len(x.w) + len(y.w) - count(*)) >= 0.6) y GROUP BY y.id),
        u AS (SELECT y.id, count(*) AS n FROM t x JOIN t y ON trim(x.canonical_url) <> '' AND x.canonical_url = y.canonical_url AND x.run_no < y.run_no GROUP BY y.id),
        h AS (SELECT y.id, count(*) AS n FROM t x JOIN t y ON trim(x.content_hash) <> '' AND x.content_hash = y.content_hash AND x.run_no < y.run_no GROUP BY y.id),
        s AS (SELECT y.id, count(*) AS n FROM t x JOIN t y ON len(x.w) > 0 AND x.w = y.w AND x.run_no < y.run_no GROUP BY y.id)
        SELECT t.id AS article_id, coalesce(u.n, 0) AS n_url, coalesce(h.n, 0) AS n_hash, coalesce(s.n, 0) AS n_title, coalesce(near.n, 0) AS n_near
        FROM t LEFT JOIN u ON u.id = t.id LEFT JOIN h ON h.id = t.id LEFT JOIN s ON s.id = t.id LEFT JOIN near ON near.id = t.id
    """,
    "p5_found": r"""
        WITH l AS (
            SELECT id, source_id, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no
            FROM articles WHERE source_id IS NOT NULL AND content IS NOT NULL),
        k AS (
            SELECT id, source_id, CAST(line_no AS INTEGER) AS line_no, regexp_replace(trim(regexp_replace(lower(line), '[\s\p{Z}]+', ' ', 'g')), '\p{Nd}+', '0', 'g') AS line FROM l),
        f AS (SELECT source_id, line FROM k WHERE line <> '' GROUP BY ALL HAVING count(DISTINCT id) >= 5)
        SELECT k.id AS article_id, k.line_no FROM k JOIN f USING (source_id, line)
    """,
    "p7_found": r"""
        WITH t AS (
            SELECT id, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(summary, '') || ' ' || coalesce(content, '')), '[\p{L}\p{N}]+') AS w FROM articles),
        s AS (SELECT id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM t WHERE len(w) >= 3),
        e AS (SELECT id, len(s) AS n, unnest(s) AS g FROM s)
        SELECT x.id AS id_a, y.id AS id_b FROM e x JOIN e y ON x.g = y.g AND x.id < y.id
        GROUP BY x.id, y.id, x.n, y.n HAVING count(*) / (x.n + y.n - count(*)) >= 0.5
    """,
    "p8_found": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}]+') AS w FROM eval_items),
        dw AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k : k + 11], ' '))) AS g FROM d WHERE len(w) >= 12),
        iw AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k : k + 11], ' '))) AS g FROM i WHERE len(w) >= 12)
        SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)
    """,
    "p2_nested_caps": """
        WITH r AS (SELECT a.id, a.run_no, a.source_id, CASE WHEN trim(a.author) <> '' THEN a.author END AS author, CASE WHEN trim(s.ownership) <> '' THEN s.ownership END AS owner, q.quality, count(*) OVER (PARTITION BY a.run_no) AS size
            FROM articles a LEFT JOIN article_quality q ON q.article_id = a.id LEFT JOIN sources s ON s.id = a.source_id),
        x AS (SELECT *, CASE WHEN author IS NOT NULL AND row_number() OVER (PARTITION BY run_no, source_id, author ORDER BY quality DESC NULLS LAST, id) > 3 THEN 1 END AS l1 FROM r),
        y AS (SELECT *, CASE WHEN l1 IS NULL AND row_number() OVER (PARTITION BY run_no, source_id, l1 IS NULL ORDER BY quality DESC NULLS LAST, id) > ceil(size * 0.05 - 1e-9) THEN 2 END AS l2 FROM x),
        z AS (SELECT *, CASE WHEN l1 IS NULL AND l2 IS NULL AND owner IS NOT NULL AND row_number() OVER (PARTITION BY run_no, owner, l1 IS NULL AND l2 IS NULL ORDER BY quality DESC NULLS LAST, id) > ceil(size * 0.1 - 1e-9) THEN 3 END AS l3 FROM y)
        SELECT id AS article_id, coalesce(l1, l2, l3) IS NULL AS kept, CAST(coalesce(l1, l2, l3) AS INTEGER) AS level FROM z
    """,
    "p7_groups": r"""
        WITH RECURSIVE t AS (
            SELECT id, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(summary, '') || ' ' || coalesce(content, '')), '[\p{L}\p{N}]+') AS w FROM articles),
        s AS (SELECT id, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) AS s FROM t WHERE len(w) >= 5),
        c AS (SELECT id, s, min(id) OVER (PARTITION BY s) AS class_id FROM s),
        h AS (SELECT id AS c, s, len(s) AS n FROM c WHERE id = class_id), e AS (SELECT c, n, unnest(s) AS g FROM h),
        l AS MATERIALIZED (SELECT x.c AS a, y.c AS b FROM e x JOIN e y ON x.g = y.g AND x.c <> y.c GROUP BY x.c, y.c, x.n, y.n HAVING count(*) / (x.n + y.n - count(*)) >= 0.8),
        reach(c, r) AS (SELECT c, c FROM h UNION SELECT l.b, reach.r FROM reach JOIN l ON l.a = reach.c),
        k AS (SELECT c, min(r) AS group_id FROM reach GROUP BY c)
        SELECT c.id, c.class_id, k.group_id, (SELECT count(*) FROM l WHERE l.a = c.class_id) AS n_links FROM c JOIN k ON k.c = c.class_id
    """,
}
