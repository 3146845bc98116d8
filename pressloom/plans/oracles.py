"""The SQL that the core queries are compared with: written for DuckDB, from the definitions and not from the plans."""

from pressloom.functions.text import STOPWORDS
from pressloom.operators.framing import LEFT, LEFT_ACTORS, LOADED, OPINION, OPINION_TITLE, OPINION_URL, RIGHT, RIGHT_ACTORS, WEAK
from pressloom.operators.topics import lexicon


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(words)) + "]"


def fold(x: str) -> str:
    return f"strip_accents(lower({x}))"


def toks(x: str, stop: bool = False) -> str:
    found = f"list_transform(regexp_extract_all({fold(x)}, '[a-z0-9][a-z0-9''’+.#-]*'), lambda w: trim(w, '''’.-'))"
    keep = "len(w) >= 2" + (f" AND NOT list_contains({_list(STOPWORDS)}, w)" if stop else "")
    return f"list_filter({found}, lambda w: {keep})"


SPACES = r"trim(regexp_replace({}, '[\s\p{{Z}}]+', ' ', 'g'))"
BODY = "CASE WHEN len(coalesce(content, '')) > len(coalesce(summary, '')) THEN coalesce(content, '') ELSE coalesce(summary, '') END"
BLOB = f"coalesce(title, '') || '. ' || {BODY}"
KEY = r"""
    regexp_extract({u}, '^[a-zA-Z]+://([^/?#]+)', 1) AS h, regexp_extract({u}, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS p, regexp_extract({u}, '\?([^#]*)', 1) AS q
"""
TRACK = r"^(utm_\w+|fbclid|gclid|gbraid|wbraid|msclkid|mc_[ce]id|igshid|ref|ref_src|referrer|source|cmpid|ncid|smid|partner|at_medium|at_campaign|guccounter|guce_\w+|__twitter_impression|amp|spm|share|sh)$"


def keyed(src: str, url: str, cols: str, where: str = "true") -> str:
    """A subquery of ``src`` with ``key``, the canonical address of an http(s) ``url``."""
    return rf"""(
        SELECT {cols}, 'https://' || regexp_replace(regexp_replace(lower(h), '^www\.', ''), ':(80|443)$', '')
            || CASE WHEN p2 = '' THEN '/' WHEN len(p2) > 1 THEN regexp_replace(p2, '/+$', '') ELSE p2 END
            || CASE WHEN len(qs) > 0 THEN '?' || array_to_string(qs, '&') ELSE '' END AS key
        FROM (SELECT *, regexp_replace(regexp_replace(p, ';[^/]*$', ''), '(?i)/amp/?$|\.amp$|/amp\.html$', '') AS p2,
                list_transform(list_sort(list_transform(list_filter(string_split(q, '&'), lambda x: regexp_matches(x, '^[^=]+=.+') AND NOT regexp_matches(string_split(x, '=')[1], '(?i){TRACK}')),
                    lambda x: {{'k': string_split(x, '=')[1], 'v': substr(x, len(string_split(x, '=')[1]) + 2)}})), lambda r: r.k || '=' || r.v) AS qs
            FROM (SELECT *, {KEY.format(u=f"trim({url})")} FROM {src} WHERE {where})))"""


def _hits(words: list[str]) -> str:
    return f"CAST(len(list_filter({_list(words)}, lambda t: list_contains(w, t))) AS BIGINT)"


def _topic_rows() -> str:
    rows = []
    for topic, terms in lexicon().items():
        single = [t for t in terms if " " not in t and "." not in t]
        parts = [f"len(list_filter({_list(single)}, lambda t: list_contains(w, t))) * 1.0"]
        parts += [f"CASE WHEN regexp_matches(f, '(^|[^a-z0-9]){t}(es|s)?($|[^a-z0-9])') THEN 1.6 ELSE 0.0 END" for t in terms if t not in single]
        rows.append(f"SELECT id, '{topic}' AS topic, round(CAST({' + '.join(parts)} AS DOUBLE), 6) AS points FROM t")
    return " UNION ALL ".join(rows)


_TOPIC_CTE = f"""t AS (SELECT id, {toks("x")} AS w, {fold("x")} AS f FROM (SELECT id, coalesce(title, '') || '. ' || coalesce(summary, '') || ' ' || substr(coalesce(content, ''), 1, 2000) AS x FROM articles)),
    pts AS (SELECT * FROM ({_topic_rows()}) WHERE points > 0)"""
_EMPTY = "CAST([] AS VARCHAR[])"
_SPLIT = r"""regexp_replace({}, '([.!?])\s+(["''“(\[]?[A-Z0-9])', '\1' || chr(30) || '\2', 'g')"""
_FEEDS = "(SELECT DISTINCT source_id, fetched_at, status FROM raw_feeds)"



def _stories(src: str) -> str:
    """CTEs up to ``g``, the pairs of articles of ``src`` in one story, and ``st`` (id, story)."""
    return f"""r AS (SELECT id, list_distinct({toks('title', True)}) AS s, list_distinct(list_transform(coalesce(entities, {_EMPTY}), lambda e: lower(e))) AS e, retrieved_at AS t FROM {src} WHERE retrieved_at IS NOT NULL),
        w AS (SELECT id, unnest(s) AS w FROM r),
        c AS (SELECT DISTINCT x.id AS a, y.id AS b FROM w x JOIN w y ON x.w = y.w AND x.id < y.id),
        m AS (SELECT a, b, len(list_intersect(x.s, y.s)) / least(len(x.s), len(y.s)) AS k,
                CASE WHEN len(x.e) = 0 OR len(y.e) = 0 THEN 0 ELSE len(list_intersect(x.e, y.e)) / len(list_distinct(list_concat(x.e, y.e))) END AS j
            FROM c JOIN r x ON x.id = a JOIN r y ON y.id = b WHERE abs(epoch_us(x.t) - epoch_us(y.t)) <= 48 * 3600000000),
        g AS MATERIALIZED (SELECT a, b FROM m WHERE k >= 0.62 OR (k >= 0.42 AND j >= 0.34)),
        u AS (SELECT a, b FROM g UNION ALL SELECT b, a FROM g),
        reach(id, s) AS (SELECT id, id FROM {src} UNION SELECT u.b, reach.s FROM reach JOIN u ON u.a = reach.id),
        st AS (SELECT id, min(s) AS story FROM reach GROUP BY id)"""


_DIGEST = """d AS (SELECT story, sum(('0x' || substr(md5(coalesce(canonical_url, '')), 1, 15))::BIGINT) AS d, count(*) AS n FROM st JOIN articles USING (id) GROUP BY story)
        SELECT id, story, substr(sha256(CAST(d AS VARCHAR) || ':' || CAST(n AS VARCHAR)), 1, 16) AS cluster_id, n AS size FROM st JOIN d USING (story)"""


def _near(words: str) -> str:
    """CTEs up to ``g``, the pairs of articles of one source that are near by the hash of ``words`` or by title."""
    return f"""t AS (SELECT id, source_id, {toks('title', True)} AS w, {words} AS l FROM articles WHERE source_id IS NOT NULL),
        c AS (SELECT id, list_transform(l, lambda t: ('0x' || substr(md5(t), 1, 15))::BIGINT) AS h FROM t WHERE len(w) > 0),
        b AS (SELECT id, h, unnest(range(0, 60)) AS i FROM c),
        s AS (SELECT id, CAST(sum(CASE WHEN 2 * len(list_filter(h, lambda x: (x >> i) & 1 = 1)) > len(h) THEN 1::BIGINT << i ELSE 0 END) AS BIGINT) AS hash FROM b GROUP BY id),
        r AS (SELECT t.id, source_id, l, w AS ws, list_distinct(w) AS w, hash FROM t JOIN s ON s.id = t.id),
        g AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM r x JOIN r y ON x.source_id = y.source_id AND x.id < y.id
            WHERE bit_count(xor(x.hash, y.hash)) <= 6 OR len(list_intersect(x.w, y.w)) / least(len(x.w), len(y.w)) >= 0.9)"""


ORACLES: dict[str, str] = {
    "bm25_top20": r"""
        WITH w AS (SELECT id, unnest([{'c': 8.0, 'x': title}, {'c': 3.0, 'x': summary}, {'c': 1.0, 'x': content}, {'c': 5.0, 'x': array_to_string(entities, ' ')}, {'c': 4.0, 'x': array_to_string(topics, ' ')}]) AS u FROM articles),
        l AS (SELECT id, u.c AS c, regexp_extract_all(strip_accents(lower(coalesce(u.x, ''))), '[\p{L}\p{N}]+') AS ws FROM w),
        r AS (SELECT id, sum(len(ws)) AS len, """
    + ", ".join(f"sum(c * len(list_filter(ws, lambda x: x = '{t}'))) AS t{i}" for i, t in enumerate(("satellite", "planetarium", "budget")))
    + """ FROM l GROUP BY id),
        f AS (SELECT count(*) AS n, avg(len) AS a, count(*) FILTER (t0 > 0) AS n0, count(*) FILTER (t1 > 0) AS n1, count(*) FILTER (t2 > 0) AS n2 FROM r)
        SELECT id, round(CAST("""
    + " + ".join(f"(CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{i} + 0.5) / (n{i} + 0.5)) END) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * len / a))" for i in range(3))
    + """ AS DOUBLE), 9) AS bm25 FROM r, f WHERE t0 + t1 + t2 > 0 ORDER BY bm25 DESC, id LIMIT 20
    """,
    "token_stats": f"SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct FROM (SELECT doc_id, {toks('text')} AS w FROM documents)",
    "token_document_frequency": f"SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({toks('title')})) AS token FROM articles) GROUP BY token",
    "distinctive_words": f"SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({toks('title')})) AS token FROM articles) WHERE len(token) >= 4 AND NOT regexp_matches(token, '^[0-9]+$') GROUP BY token HAVING count(*) <= 6",
    "sentence_counts": f"SELECT doc_id, len(s) AS n_sentences, s[1] AS first_sentence FROM (SELECT doc_id, string_split({_SPLIT.format(SPACES.format('text'))}, chr(30)) AS s FROM documents)",
    "truncated_titles": r"""
        SELECT id, CASE WHEN len(title) <= 40 THEN title ELSE regexp_replace(CASE WHEN contains(substr(title, 1, 40), ' ') THEN regexp_replace(substr(title, 1, 40), ' [^ ]*$', '') ELSE substr(title, 1, 40) END, '[ ,;:.-]+$', '') || '…' END AS short_title
        FROM articles
    """,
    "content_hashes": f"SELECT id, sha256({fold(SPACES.format('title'))} || chr(31) || {fold(SPACES.format('canonical_url'))} || chr(31)) AS digest FROM articles",
    "title_simhash": f"""
        WITH c AS (SELECT id, list_transform({toks('title')}, lambda t: ('0x' || substr(md5(t), 1, 15))::BIGINT) AS h FROM articles),
        b AS (SELECT id, h, unnest(range(0, 60)) AS i FROM c)
        SELECT id, CAST(sum(CASE WHEN 2 * len(list_filter(h, lambda x: (x >> i) & 1 = 1)) > len(h) THEN 1::BIGINT << i ELSE 0 END) AS BIGINT) AS hash FROM b GROUP BY id
    """,
    "canonical_urls": f"SELECT id, key FROM {keyed('articles', 'url', 'id')}",
    "newest_per_source": "SELECT id, source_id FROM articles QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY retrieved_at DESC NULLS LAST, id) <= 40",
    "richest_copy": f"""
        WITH k AS (SELECT * FROM {keyed('articles', 'url', 'id, content, summary, published_at')})
        SELECT key, id, n_copies FROM (SELECT key, id, count(*) OVER (PARTITION BY key) AS n_copies,
            row_number() OVER (PARTITION BY key ORDER BY len(coalesce(content, '')) DESC, len(coalesce(summary, '')) DESC, coalesce(published_at, '') <> '' DESC, id) AS n FROM k) WHERE n = 1
    """,
    "content_hash_copies": "SELECT content_hash, count(*) AS n_copies FROM articles WHERE content_hash <> '' GROUP BY content_hash HAVING count(*) > 1",
    "enabled_sources": "SELECT id, lower(name) AS name FROM sources WHERE enabled",
    "enriched_articles": "SELECT a.id, s.lean AS outlet_lean, s.source_type, s.country FROM articles a LEFT JOIN sources s ON s.id = a.source_id",
    "ingest_stats": """
        SELECT count(*) AS n_articles, count(DISTINCT source_id) AS n_sources, strftime(max(retrieved_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS newest,
            count(*) FILTER (retrieved_at >= (SELECT max(retrieved_at) FROM articles) - INTERVAL 24 HOUR) AS n_last_day FROM articles
    """,
    "recent_articles": "SELECT id FROM articles ORDER BY retrieved_at DESC, id LIMIT 100",
    "retention": "SELECT id FROM articles WHERE retrieved_at IS NULL OR retrieved_at >= TIMESTAMPTZ '2024-06-01 00:00:00+00' - INTERVAL (180 * 24) HOUR",
    "feed_streaks": f"""
        WITH f AS {_FEEDS}, i AS (SELECT *, sum(CASE WHEN status = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY fetched_at, status ROWS UNBOUNDED PRECEDING) AS g FROM f),
        s AS (SELECT source_id, g, count(*) FILTER (status = 'error') AS n FROM i GROUP BY source_id, g)
        SELECT source_id, max(n) AS worst, (SELECT count(*) FROM f WHERE f.source_id = s.source_id) AS n_fetches FROM s GROUP BY source_id
    """,
    "feed_states": f"""
        WITH f AS {_FEEDS}, g AS (SELECT source_id, max({{'a': fetched_at, 'b': status}}) FILTER (status <> 'error') AS good FROM f GROUP BY source_id)
        SELECT f.source_id, strftime(max(fetched_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS last_fetch, strftime(max(fetched_at) FILTER (status <> 'error') AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS last_success,
            max_by(status, {{'a': fetched_at, 'b': status}}) AS last_status, count(*) FILTER (good IS NULL OR {{'a': fetched_at, 'b': status}} > good) AS failures
        FROM f JOIN g USING (source_id) GROUP BY f.source_id
    """,
    "due_feeds": f"""
        WITH f AS {_FEEDS}, g AS (SELECT source_id, max({{'a': fetched_at, 'b': status}}) FILTER (status <> 'error') AS good FROM f GROUP BY source_id),
        n AS (SELECT f.source_id, count(*) FILTER (good IS NULL OR {{'a': fetched_at, 'b': status}} > good) AS failures FROM f JOIN g USING (source_id) GROUP BY f.source_id)
        SELECT s.id, coalesce(n.failures, 0) AS failures FROM sources s LEFT JOIN n ON n.source_id = s.id WHERE s.enabled AND coalesce(n.failures, 0) < 2
    """,
    "new_entries": f"SELECT DISTINCT key AS canonical_url FROM {keyed('raw_entries', 'link', 'entry_id', 'link IS NOT NULL')} k WHERE NOT EXISTS (SELECT 1 FROM articles a, (SELECT (min(run_no) + max(run_no)) / 2 AS m FROM articles) WHERE run_no <= m AND a.canonical_url = k.key)",
    "known_entries": f"SELECT DISTINCT key AS canonical_url FROM {keyed('raw_entries', 'link', 'entry_id', 'link IS NOT NULL')} k WHERE EXISTS (SELECT 1 FROM articles a WHERE a.canonical_url = k.key)",
    "upserted_articles": """
        WITH m AS (SELECT (min(run_no) + max(run_no)) / 2 AS m FROM articles WHERE canonical_url IS NOT NULL),
        r AS (SELECT a.*, run_no > m AS late FROM articles a, m WHERE canonical_url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY canonical_url, run_no > m ORDER BY id DESC) = 1),
        o AS (SELECT * FROM r WHERE NOT late), n AS (SELECT * FROM r WHERE late)
        SELECT coalesce(o.canonical_url, n.canonical_url) AS canonical_url, coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.title ELSE o.title END AS title,
            greatest(len(coalesce(o.summary, '')), len(coalesce(n.summary, ''))) AS n_summary, greatest(len(coalesce(o.content, '')), len(coalesce(n.content, ''))) AS n_content,
            coalesce(o.published_at, n.published_at) AS published_at, CASE WHEN o.id IS NULL THEN 'inserted' WHEN n.id IS NULL THEN 'kept' ELSE 'updated' END AS change
        FROM o FULL OUTER JOIN n ON o.canonical_url = n.canonical_url
    """,
    "newest_fetches": f"SELECT source_id, strftime(fetched_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS fetched, status FROM {_FEEDS} QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY fetched_at DESC, status) <= 3",
    "unused_sources": "SELECT id FROM sources s WHERE NOT EXISTS (SELECT 1 FROM articles a WHERE a.source_id = s.id)",
    "event_props": "SELECT event_type, count(*) AS n_events, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS max_k FROM events GROUP BY event_type",
    "lean_shares": "SELECT coalesce(bias.lean, 'unknown') AS lean, count(*) AS n, round(count(*) / (SELECT count(*) FROM articles), 6) AS share FROM articles GROUP BY 1",
    "topic_points": f"WITH {_TOPIC_CTE} SELECT id, topic, points FROM pts",
    "article_topics": f"""
        WITH {_TOPIC_CTE}, g AS (SELECT *, topic IN ('technology', 'world', 'business', 'science') AS generic FROM pts),
        s AS (SELECT id, topic, CASE WHEN generic AND bool_or(NOT generic AND points >= 2.0) OVER (PARTITION BY id) THEN points * 0.45 ELSE points END AS v FROM g),
        r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, topic) AS n, max(v) OVER (PARTITION BY id) AS best FROM s),
        k AS (SELECT id, string_agg(topic, ',' ORDER BY n) AS topics FROM r WHERE n <= 3 AND best >= 1.5 AND v >= greatest(1.5, best * 0.45) GROUP BY id)
        SELECT a.id, coalesce(k.topics, 'general') AS topics FROM articles a LEFT JOIN k USING (id)
    """,
    "framing_measures": f"""
        SELECT id, {_hits(LOADED)} AS n_loaded, {_hits(OPINION)} AS n_opinion, {_hits(LEFT)} AS n_left, {_hits(RIGHT)} AS n_right, {_hits(LEFT_ACTORS)} AS n_left_actors, {_hits(RIGHT_ACTORS)} AS n_right_actors
        FROM (SELECT id, {toks(BLOB)} AS w FROM articles)
    """,
    "lean_badges": """
        SELECT id, CASE WHEN bias IS NULL THEN 'unknown' WHEN coalesce(bias.lean, 'unknown') <> 'unknown' THEN bias.lean WHEN coalesce(bias.source_lean, 'unknown') NOT IN ('unknown', 'not-applicable') THEN bias.source_lean ELSE 'unknown' END AS shown_lean,
            CASE WHEN bias IS NULL THEN 'none' WHEN coalesce(bias.lean, 'unknown') <> 'unknown' THEN 'article' WHEN coalesce(bias.source_lean, 'unknown') NOT IN ('unknown', 'not-applicable') THEN 'source' ELSE 'none' END AS basis
        FROM articles
    """,
    "story_coverage": """
        WITH a AS (SELECT cluster_id, source_id, coalesce(bias.lean_score, 0.0) AS s, coalesce(bias.is_opinion, false) AS o, coalesce(bias.lean, 'unknown') IN ('left', 'center-left', 'center', 'center-right', 'right') AS p FROM articles WHERE cluster_id <> '')
        SELECT cluster_id, count(*) AS n_articles, count(DISTINCT source_id) AS n_sources, count(*) FILTER (o) AS n_opinion,
            round(CASE WHEN count(*) FILTER (p) >= 2 THEN max(s) FILTER (p) - min(s) FILTER (p) ELSE 0.0 END, 3) AS lean_spread FROM a GROUP BY cluster_id
    """,
    "story_headline_terms": f"""
        WITH a AS (SELECT cluster_id, title, coalesce(bias.lean_score, 0.0) AS s, coalesce(bias.lean, 'unknown') IN ('left', 'center-left', 'center', 'center-right', 'right') AS p FROM articles WHERE cluster_id <> ''),
        d AS (SELECT *, CASE WHEN p AND s < -0.15 THEN 'l' WHEN p AND s > 0.15 THEN 'r' END AS side FROM a),
        g AS (SELECT cluster_id, bool_or(side = 'l') AS hl, bool_or(side = 'r') AS hr FROM d GROUP BY cluster_id),
        w AS (SELECT cluster_id, w, bool_or(side = 'l') AS l, bool_or(side = 'r') AS r FROM (SELECT cluster_id, side, unnest({toks('title', True)}) AS w FROM d WHERE side IS NOT NULL) GROUP BY cluster_id, w)
        SELECT g.cluster_id, CASE WHEN hr THEN coalesce((SELECT list(w ORDER BY w)[1:12] FROM w WHERE w.cluster_id = g.cluster_id AND l AND NOT r), {_EMPTY}) ELSE {_EMPTY} END AS left_terms,
            CASE WHEN hl THEN coalesce((SELECT list(w ORDER BY w)[1:12] FROM w WHERE w.cluster_id = g.cluster_id AND r AND NOT l), {_EMPTY}) ELSE {_EMPTY} END AS right_terms FROM g
    """,
    "citation_check": r"""
        WITH x AS (SELECT doc_id, coalesce(text, '') || ' [' || (doc_id % 5) || '] [7][' || (doc_id % 12) || '].' AS x FROM documents),
        m AS (SELECT *, list_distinct(regexp_extract_all(x, '\[(\d{1,2})\]', 1)) AS m FROM x)
        SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(m, lambda k: CAST(k AS INTEGER)), lambda k: k BETWEEN 1 AND 3))), ',') AS valid,
            array_to_string(list_sort(list_transform(list_filter(m, lambda k: CAST(k AS INTEGER) NOT BETWEEN 1 AND 3), lambda k: '[' || k || ']')), ',') AS invalid,
            len(trim(regexp_replace(regexp_replace(regexp_replace(x, '\[(0?0|0?[4-9]|[1-9]\d)\]', '', 'g'), '[ \t]{2,}', ' ', 'g'), ' +([.,;:!?])', '\1', 'g'))) AS n_clean FROM m
    """,
    "sentence_ranks": f"""
        WITH p AS (SELECT doc_id, unnest(string_split({_SPLIT.format(SPACES.format('text'))}, chr(30))) AS s, unnest(range(len(string_split({_SPLIT.format(SPACES.format('text'))}, chr(30))))) AS k FROM documents),
        h AS (SELECT *, sum(CASE WHEN len(s) < 25 AND k > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) - 1 AS pos FROM p WHERE s <> ''),
        s AS (SELECT doc_id, CAST(pos AS BIGINT) AS pos, string_agg(s, ' ' ORDER BY k) AS s FROM h GROUP BY doc_id, pos),
        t AS (SELECT doc_id, pos, {toks('s', True)} AS w FROM s), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        e AS (SELECT doc_id, pos, unnest(list_distinct(w)) AS x FROM t), f AS (SELECT doc_id, x, count(*) AS df FROM e GROUP BY doc_id, x),
        c AS (SELECT doc_id, pos, sum(ln(1 + n / (1 + df)) * df) / sqrt(count(*)) AS c FROM e JOIN f USING (doc_id, x) JOIN n USING (doc_id) GROUP BY doc_id, pos)
        SELECT doc_id, pos, round(coalesce(c / (1 + 0.35 * pos) * CASE WHEN len(w) BETWEEN 8 AND 45 THEN 1.0 WHEN len(w) < 8 THEN 0.55 ELSE 0.8 END, 0.0), 6) AS score FROM t LEFT JOIN c USING (doc_id, pos)
    """,
    "stream_daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "question_coverage": f"""
        WITH t AS (SELECT id, {fold("concat_ws(' ', coalesce(title, ''), coalesce(summary, ''), substr(coalesce(content, ''), 1, 1500), array_to_string(coalesce(entities, CAST([] AS VARCHAR[])), ' '), array_to_string(coalesce(topics, CAST([] AS VARCHAR[])), ' '))")} AS f FROM articles)
        SELECT id, round(len(list_filter(['satellite', 'budget', 'planetarium', 'approved'], lambda x: regexp_matches(f, '(^|[^a-z0-9])' || x || '(es|s)?($|[^a-z0-9])'))) / 4, 6) AS coverage FROM t
    """,
    "turn_intents": r"""
        SELECT id, CASE WHEN regexp_matches(title, '(?i)\b(different sources|other sources|how (?:are|is|do|does)\s+\w*\s*(?:sources?|outlets?|media|publications?|papers?)\b|compare (?:the )?coverage|coverage compare|both sides|left and right|bias(?:ed)?|spin|framing|how .{0,30}covering|who(?:''s| is) reporting)\b') THEN 'compare_coverage'
                WHEN regexp_matches(title, '(?i)\b(summar(?:ise|ize|y)|tl;?dr|recap|catch me up|what did i miss|brief me)\b') THEN 'summarize' ELSE 'search' END AS intent,
            CASE WHEN regexp_matches(title, '(?i)\b(right now|breaking|last hour|past hour)\b') THEN 6 WHEN regexp_matches(title, '(?i)\b(today|todays|today''s|so far today|this morning|tonight)\b') THEN 24 WHEN regexp_matches(title, '(?i)\byesterday\b') THEN 48
                WHEN regexp_matches(title, '(?i)\b(last|past|this)\s+(?:24|48)\s*hours?\b') THEN 48 WHEN regexp_matches(title, '(?i)\b(this week|past week|last week|last 7 days|recently)\b') THEN 168 WHEN regexp_matches(title, '(?i)\b(this month|past month|last month|last 30 days)\b') THEN 720 ELSE 96 END AS hours
        FROM articles
    """,
    "html_text": r"""
        SELECT entry_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(coalesce(summary, ''), '(?i)<br\s*/?>|</p>|</div>|</li>', chr(10), 'g'), '<[^>]+>', ' ', 'g'),
            '&#8217;', '’'), '&quot;', '"'), chr(160), ' '), '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM raw_entries
    """,
    "story_groups": """
        WITH a AS (SELECT id, cluster_id, source_id, retrieved_at, row_number() OVER (PARTITION BY cluster_id ORDER BY retrieved_at DESC, id) AS n FROM articles WHERE cluster_id <> '')
        SELECT cluster_id, max(CASE WHEN n = 1 THEN id END) AS lead_id, count(*) AS n_members, count(DISTINCT source_id) AS n_sources, coalesce(list(id ORDER BY n) FILTER (n BETWEEN 2 AND 13), CAST([] AS BIGINT[])) AS related FROM a GROUP BY cluster_id
    """,
    "story_pairs": f"WITH RECURSIVE {_stories('articles')} SELECT a, b FROM g",
    "story_members": f"WITH RECURSIVE {_stories('articles')} SELECT id, story FROM st",
    "story_ids": f"WITH RECURSIVE {_stories('articles')}, {_DIGEST}",
    "story_sizes": f"WITH RECURSIVE {_stories('articles')} SELECT size, count(*) AS n_stories FROM (SELECT story, count(*) AS size FROM st GROUP BY story) GROUP BY size",
    "reclustered": f"WITH RECURSIVE now AS (SELECT max(retrieved_at) AS n FROM articles), win AS (SELECT * FROM articles, now WHERE retrieved_at >= n - INTERVAL 48 HOUR AND retrieved_at <= n), {_stories('win')}, {_DIGEST}",
    "near_title_pairs": f"WITH {_near(toks('title', True))} SELECT a, b FROM g",
    "near_text_links": f"""WITH {_near(toks("coalesce(title, '') || ' ' || coalesce(summary, '')", True))},
        k AS (SELECT id, source_id, md5(array_to_string(l, ' ') || '|' || array_to_string(list_sort(w), ' ')) AS k FROM r),
        h AS (SELECT source_id, k, min(id) AS class_id, count(*) AS n_copies FROM k GROUP BY ALL),
        p AS (SELECT g.a AS i, k.source_id, k.k FROM g JOIN k ON k.id = g.b UNION SELECT g.b, k.source_id, k.k FROM g JOIN k ON k.id = g.a)
        SELECT k.id, h.class_id, h.n_copies, (SELECT count(*) FROM p WHERE p.i = k.id AND p.k <> k.k) AS n_links FROM k JOIN h ON h.source_id = k.source_id AND h.k = k.k""",
    "near_title_kept": f"""WITH RECURSIVE {_near(toks('title', True))},
        o AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM articles),
        step(n, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
            SELECT o.n, CASE WHEN EXISTS (SELECT 1 FROM g WHERE g.b = o.id AND list_contains(step.kept, g.a)) THEN step.kept ELSE list_append(step.kept, o.id) END FROM step JOIN o ON o.n = step.n + 1),
        k AS (SELECT unnest(kept) AS id FROM (SELECT kept FROM step ORDER BY n DESC LIMIT 1))
        SELECT a.id, coalesce((SELECT min(g.a) FROM g JOIN k ON k.id = g.a WHERE g.b = a.id AND a.id NOT IN (SELECT id FROM k)), a.id) AS kept_id FROM articles a""",
    "exact_kept": """
        WITH RECURSIVE k AS (SELECT id, unnest([CASE WHEN trim(canonical_url) <> '' THEN 'u' || canonical_url WHEN trim(url) <> '' THEN 'u' || url END, CASE WHEN trim(content_hash) <> '' THEN 'h' || content_hash END]) AS key FROM articles),
        e AS (SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y USING (key)),
        reach(id, s) AS (SELECT id, id FROM articles UNION SELECT e.b, reach.s FROM reach JOIN e ON e.a = reach.id),
        g AS (SELECT id, min(s) AS grp FROM reach GROUP BY id),
        r AS (SELECT g.grp, a.id, row_number() OVER (PARTITION BY g.grp ORDER BY len(coalesce(content, '')) DESC, len(coalesce(summary, '')) DESC, coalesce(published_at, '') <> '' DESC, a.id) AS n, count(*) OVER (PARTITION BY g.grp) AS c FROM g JOIN articles a USING (id))
        SELECT id AS kept_id, grp AS first_id, c AS n_copies FROM r WHERE n = 1
    """,
    "index_size": r"""
        WITH l AS (SELECT id, len(regexp_extract_all(strip_accents(lower(concat_ws(' ', title, summary, content, array_to_string(entities, ' '), array_to_string(topics, ' ')))), '[\p{L}\p{N}]+')) AS n FROM articles WHERE id % 10 <> 0)
        SELECT count(*) AS n_rows, round(avg(n), 6) AS mean_length FROM l
    """,
    "article_framing": f"""
        WITH a AS (SELECT a.id, coalesce(title, '') AS title, coalesce(a.url, '') AS url, coalesce(topics, []) AS topics, coalesce(s.lean, 'unknown') AS prior, coalesce(s.confidence, 'low') AS conf, s.source_type AS st, {BLOB} AS blob FROM articles a LEFT JOIN sources s ON s.id = a.source_id),
        w AS (SELECT *, {toks('blob')} AS w, {toks('title')} AS tw FROM a),
        n AS (SELECT *, greatest(1, len(w)) AS n, {_hits(LOADED)} AS ld, {_hits(OPINION)} AS op, {_hits(LEFT)} AS l, {_hits(RIGHT)} AS r, {_hits(LEFT_ACTORS)} AS la, {_hits(RIGHT_ACTORS)} AS ra,
            len(regexp_extract_all(blob, '{WEAK}')) AS wk, regexp_matches(url, '{OPINION_URL}') OR regexp_matches(title, '{OPINION_TITLE}') AS sec, len(list_filter({_list(LOADED)}, lambda t: list_contains(tw, t))) AS tl FROM w),
        m AS (SELECT *, ld * 100.0 / n AS dens, sec OR op >= 4 AS o, l + r AS fr, la + ra AS ac, list_has_any(topics, ['us-politics', 'geopolitics', 'world', 'india', 'europe', 'asia']) OR la + ra > 0 AS pol,
            CASE WHEN prior IN ('left', 'center-left', 'center', 'center-right', 'right') THEN CASE conf WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.65::DOUBLE ELSE 0.35::DOUBLE END * 0.55::DOUBLE ELSE 0 END AS pw,
            CASE prior WHEN 'left' THEN -1.0 WHEN 'center-left' THEN -0.5 WHEN 'center-right' THEN 0.5 WHEN 'right' THEN 1.0 ELSE 0.0 END AS ps FROM n),
        k AS (SELECT *, CASE WHEN ac >= 3 THEN abs(ra - la) / ac::DOUBLE ELSE 0 END AS im, CASE WHEN fr > 0 THEN (r - l) / fr::DOUBLE ELSE 0 END AS f FROM m),
        e AS (SELECT *, least(0.8::DOUBLE, 0.25::DOUBLE * fr + 0.3::DOUBLE * im) AS ev FROM k),
        c AS (SELECT *, CASE WHEN ev <= 0.01 AND pw <= 0.01 THEN 0 ELSE (ps * pw + f * ev) / greatest(0.01::DOUBLE, pw + ev) END AS sc FROM e)
        SELECT id, CASE WHEN NOT pol THEN 'not-applicable' WHEN sc <= -0.66 THEN 'left' WHEN sc <= -0.2 THEN 'center-left' WHEN sc < 0.2 THEN 'center' WHEN sc < 0.66 THEN 'center-right' ELSE 'right' END AS lean,
            CASE WHEN pol THEN round(sc, 3) ELSE 0.0 END AS lean_score,
            CASE WHEN NOT pol THEN CASE WHEN len(topics) > 0 THEN 'medium' ELSE 'low' END WHEN pw + ev >= 1.0 AND fr >= 2 THEN 'high' WHEN pw + ev >= 0.5 THEN 'medium' ELSE 'low' END AS confidence,
            round(least(1.0::DOUBLE, 0.3::DOUBLE * least(1.0::DOUBLE, dens::DOUBLE / 2) + 0.3::DOUBLE * least(1.0::DOUBLE, op / 6.0::DOUBLE) + CASE WHEN o THEN 0.3::DOUBLE ELSE 0 END + 0.1::DOUBLE * least(1.0::DOUBLE, wk / 3.0::DOUBLE)), 3) AS subjectivity, o AS is_opinion,
            array_to_string(list_sort(list_filter([CASE WHEN sec THEN 'opinion' END, CASE WHEN NOT sec AND op >= 4 THEN 'commentary-style' END, CASE WHEN st = 'vendor' THEN 'first-party' END, CASE WHEN st = 'aggregator' THEN 'aggregator' END,
                CASE WHEN prior = 'state-affiliated' THEN 'state-affiliated' END, CASE WHEN dens >= 1.2 THEN 'emotive-language' END, CASE WHEN tl > 0 THEN 'charged-headline' END, CASE WHEN rtrim(title) LIKE '%?' THEN 'question-headline' END,
                CASE WHEN regexp_matches(title, '[“"''].+[”"'']') AND len(title) > 30 THEN 'quote-headline' END, CASE WHEN wk > 0 THEN 'anonymous-sourcing' END, CASE WHEN pol AND ac >= 3 AND im >= 0.6 THEN 'one-sided-attribution' END], lambda x: x IS NOT NULL)), ',') AS framing FROM c
    """,
}
ORACLES["stream_feed_states"] = ORACLES["feed_states"]
