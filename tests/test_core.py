import random

import pytest
from pyspark.sql import functions as F

from pressloom.functions import text as X
from pressloom.functions.urls import canonical_url
from pressloom.operators import answers, briefing, cluster, components, dedupe, framing, interests, normalize, ranked, state, summarize, topics
from pressloom.search import question, ranking
from pressloom.search.terms import token_list
from pressloom.sources import feeds, registry

RSS = b"""<?xml version="1.0"?><rss version="2.0" xmlns:media="http://search.yahoo.com/mrss/"><channel><title>T</title><language>en-us</language>
<item><title>One &amp; two</title><link>https://a.example/1</link><description>&lt;p&gt;Hello&lt;/p&gt;</description><pubDate>Mon, 16 Jan 2023 03:01:17 +0100</pubDate><category>X</category><category>x</category><media:content url="https://a.example/i.png"/></item>
<item><title>no link</title></item></channel></rss>"""
ATOM = b"""<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link rel="self" href="https://a.example/self"/><link href="https://a.example/alt"/><author><name>Ann</name></author><updated>2023-01-01T00:00:00Z</updated></entry></feed>"""
RDF = b"""<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/"><channel><title>C</title></channel><item><title>R</title><link>https://a.example/r</link></item></rdf:RDF>"""


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "url, key",
    [
        ("http://www.A.example/x/?utm_source=f&b=2&a=1#top", "https://a.example/x?a=1&b=2"),
        ("https://a.example:443/", "https://a.example/"),
        ("https://a.example", "https://a.example/"),
        ("https://a.example/x/amp/", "https://a.example/x"),
        ("https://a.example/x?a=&ref=1", "https://a.example/x"),
        ("not a url", "not a url"),
        (None, ""),
    ],
)
def test_canonical_url(spark, url, key):
    assert one(spark, canonical_url(F.col("u")), u=url) == key


def test_text_functions(spark):
    assert one(spark, X.fold(F.col("t")), t="Türkiye ÉTÉ") == "turkiye ete"
    assert one(spark, X.tokens(F.col("t")), t="The GPU's 5-nm chips, and C++!") == ["gpu's", "5-nm", "chips", "c++"]
    assert token_list("The GPU's 5-nm chips, and C++!") == ["gpu's", "5-nm", "chips", "c++"]
    assert one(spark, X.tokens(F.col("t")), t=None) == []
    assert one(spark, X.strip_html(F.col("t")), t="<p>A&nbsp;&amp; b</p><script>x</script>c") == "A & b\nc"
    assert one(spark, X.strip_html(F.col("t")), t=None) == ""
    assert one(spark, X.sentences(F.col("t")), t="One is long enough to stand alone. No. Two is also long enough here.") == ["One is long enough to stand alone. No.", "Two is also long enough here."]
    assert one(spark, X.truncate(F.col("t"), 9), t="hello world again") == "hello…"
    text = "A note. The European Union met NVIDIA and NVIDIA again. Today Narendra Modi spoke."
    assert one(spark, X.entities(F.col("t")), t=text) == ["NVIDIA", "European Union", "Narendra Modi"]
    assert one(spark, X.hamming(F.lit(-1).cast("long"), F.lit(0).cast("long")), t="") == 64
    assert one(spark, normalize.tidy(F.col("t")), t="Intro\n- first\n* second!\n") == "Intro first. second!"
    assert one(spark, X.contains_term(F.col("t"), "tariff"), t="new tariffs rise") and not one(spark, X.contains_term(F.col("t"), "riff"), t="new tariffs rise")


def test_feeds():
    rows, missed = feeds.parse_feed(RSS)
    assert missed == 1 and rows[0]["title"] == "One & two" and rows[0]["summary"] == "Hello" and rows[0]["content"] == "" and rows[0]["categories"] == ["X"] and rows[0]["image_url"].endswith("i.png") and rows[0]["language"] == "en-us"
    assert feeds.parse_feed(ATOM)[0][0]["link"] == "https://a.example/alt" and feeds.parse_feed(ATOM)[0][0]["author"] == "Ann"
    assert feeds.parse_feed(RDF)[0][0]["title"] == "R"
    assert feeds.parse_feed(b"\xef\xbb\xbf  " + RSS.replace(b"Hello", b"He\x01llo"))[0][0]["summary"] == "Hello"
    for bad in (None, b"", b"<html><body/></html>", RSS[:200]):
        with pytest.raises(feeds.FeedError):
            feeds.parse_feed(bad)


def test_feed_rows_keep_errors(spark):
    df = spark.createDataFrame([("a", bytearray(RSS)), ("b", None), ("c", bytearray(b"<html/>"))], "source_id string, body binary").withColumn("fetched_at", F.current_timestamp())
    out = {r["source_id"]: r for r in feeds.feed_items(df).collect()}
    assert out["a"]["error"] is None and out["b"]["error"] and out["c"]["error"]


def test_registry():
    data = {"defaults": {"country": "DE"}, "sources": [{"id": "a", "url": "https://a", "categories": "x, y"}, {"id": "a", "url": "https://b"}, {"id": "c", "url": "ftp://c"}, "junk", {"id": "d", "url": "http://d", "enabled": False, "lean": "odd"}]}
    got = registry.parse_registry(data)
    assert [r["id"] for r in got] == ["a", "d"] and got[0]["categories"] == ["x", "y"] and got[0]["country"] == "DE" and got[1]["lean"] == "unknown" and not got[1]["enabled"]
    with pytest.raises(registry.RegistryError):
        registry.parse_registry({"sources": []})


def test_components_and_first_kept_match_brute_force(spark):
    rng = random.Random(3)
    pairs = list({tuple(sorted(rng.sample(range(60), 2))) for _ in range(45)})
    df = spark.createDataFrame(pairs, "src long, dst long")
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    parent = {n: n for p in pairs for n in p}
    for _ in range(60):
        for a, b in pairs:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent
    assert components.components(spark.createDataFrame([], "src long, dst long")).count() == 0
    kept: dict[int, int] = {}
    for i in range(60):
        dup = sorted(a for a, b in pairs if b == i and kept[a] == a)
        kept[i] = dup[0] if dup else i
    out = dedupe.first_kept(spark.range(60), df.toDF("a", "b"))
    assert {r["id"]: r["kept_id"] for r in out.collect()} == kept


def test_ranks_span_tasks(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("q")).repartition(5)
    out = ranked.ranked(df, ["g"], [F.desc("q"), F.asc("id")]).collect()
    for g in range(3):
        order = sorted((r for r in out if r["g"] == g), key=lambda r: (-r["q"], r["id"]))
        assert [r["rank"] for r in order] == list(range(1, len(order) + 1))
    nulls = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, id int")
    assert sorted(r["rank"] for r in ranked.ranked(nulls, ["g"], [F.asc("id")]).collect()) == [1, 1, 2]
    assert ranked.ranked(nulls.limit(0), ["g"], [F.asc("id")]).count() == 0


def test_near_pairs_match_brute_force(spark):
    titles = [("s", "storm shuts northern bridge again today"), ("s", "storm shuts northern bridge again today"), ("s", "storm shuts northern bridge again"), ("t", "storm shuts northern bridge again today"), ("s", "quite different words stand here"), ("s", None), (None, "storm shuts northern bridge again today")]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(titles)], "id long, source string, title string")
    assert {tuple(r) for r in dedupe.near_pairs(df, "id", "source", "title").collect()} == {(0, 1), (0, 2), (1, 2)}


def test_stories(spark):
    rows = [(1, "Chip maker unveils faster graphics card", ["Acme"], 0), (2, "Chip maker unveils new faster graphics card", ["Acme"], 3), (3, "Chip maker unveils faster graphics card", ["Acme"], 400), (4, "Senate passes budget", [], 1), (5, None, None, 1)]
    df = spark.createDataFrame(rows, "id long, title string, entities array<string>, h int").withColumn("t", F.timestamp_seconds(F.col("h") * 3600))
    got = {r["id"]: r["story"] for r in cluster.stories(df, "id", "title", "entities", F.col("t")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_topics_and_framing(spark):
    rows = [(1, "Linux kernel and wayland", "systemd", "", [], "", "unknown", "low", "trade"), (2, "Senate slams shocking scandal", "Trump trump gop democrat biden", "", ["us-politics"], "https://x/opinion/1", "left", "high", "vendor"), (3, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, title string, summary string, content string, topics array<string>, url string, source_lean string, source_confidence string, source_type string")
    assert {r["id"]: r["topics"] for r in topics.with_topics(df.drop("topics")).collect()} == {1: ["linux"], 2: ["general"], 3: ["general"]}
    out = {r["id"]: r for r in framing.assess(df).collect()}
    assert out[1]["lean"] == "not-applicable" and out[3]["confidence"] == "low"
    assert out[2]["is_opinion"] and {"opinion", "charged-headline", "first-party", "emotive-language"} <= set(out[2]["framing"]) and out[2]["lean_score"] < 0


def test_question_parsing(spark):
    parse = lambda *a: question.parse(spark, *a)
    assert [parse(t).hours for t in ("news today", "this week", "last month", "NVIDIA")] == [24, 168, 720, 96]
    q = parse("what's happening with the auto-cpufreq project?")
    assert "auto-cpufreq" in q.keywords and q.intent == "search"
    history = [{"role": "user", "content": "What did NVIDIA announce?"}, {"role": "assistant", "content": "..."}]
    f = parse("only the biggest ones", history)
    assert f.follow_up and f.intent == "follow_up" and "NVIDIA" in f.entities
    assert not parse("only the biggest ones").follow_up and not parse("Why did Intel cut jobs", history).follow_up and parse("why is it late", history).follow_up
    assert parse("how are different sources covering it").intent == "compare_coverage"
    assert parse("").terms == [] and parse(None).terms == []
    r = question.refined(q, {"entities": ["Linux", 3, "linux"], "keywords": "no list", "hours": 5000})
    assert r.entities == [*q.entities, "Linux"] and r.keywords == q.keywords and r.hours == 720


def test_plans_of_a_table_of_turns(spark):
    turns = [("a", 1, "user", "What did NVIDIA announce?"), ("a", 2, "assistant", "Much."), ("a", 3, "user", "tell me more"), ("b", 1, "user", "tell me more"), ("b", 2, "user", None)]
    out = {(r["session_id"], r["id"]): r for r in question.plans(spark.createDataFrame(turns, "session_id string, id long, role string, content string")).collect()}
    assert out["a", 3]["entities"] == ["NVIDIA"] and "announce" in out["a", 3]["keywords"] and not out["b", 1]["follow_up"] and out["b", 2]["keywords"] == []


def test_bm25_matches_sqlite(spark):
    import sqlite3

    rng = random.Random(5)
    vocabulary = ["tariff", "steel", "bank", "rates", "north", "café", "chip", "fab"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=4)), " ".join(rng.choices(vocabulary, k=12))) for i in range(60)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(title, summary, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("insert into f(rowid, title, summary) values (?, ?, ?)", rows)
    for match, phrases in (("tariff* OR cafe", [ranking.Phrase(("tariff",), True), ranking.Phrase(("cafe",))]), ('"bank rates"', [ranking.Phrase(("bank", "rates"))])):
        want = {i: -s for i, s in db.execute("select rowid, bm25(f, 8, 3) from f where f match ?", (match,))}
        df = spark.createDataFrame(rows, "id long, title string, summary string")
        got = {r["id"]: r["bm25"] for r in ranking.bm25(df, phrases, {"title": 8.0, "summary": 3.0}).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_diversified_is_the_sequential_pass(spark):
    rng = random.Random(1)
    rows = [(i, round(rng.random(), 3), f"s{rng.randrange(3)}", rng.choice(["", "c1", "c2"])) for i in range(40)]
    got = [r["id"] for r in ranking.diversified(spark.createDataFrame(rows, "id long, score double, source_id string, cluster_id string"), 8).orderBy("place").collect()]
    kept, rest, src, cl = [], [], {}, {}
    for i, s, a, c in sorted(rows, key=lambda r: (-r[1], r[0])):
        c = c or f"solo:{i}"
        if len(kept) == 8:
            break
        if src.get(a, 0) >= 2 or cl.get(c, 0) >= 2:
            rest.append(i)
            continue
        src[a], cl[c] = src.get(a, 0) + 1, cl.get(c, 0) + 1
        kept.append(i)
    assert got == (kept + rest)[:8]


def test_summaries_and_answers(spark):
    body = "The city council approved the new bridge budget on Monday. " + "Weather was fine in the area and people were out. " + "The bridge budget of the council will rise next year after the vote."
    df = spark.createDataFrame([(1, "T", "short", body), (2, "Title", "", ""), (3, None, None, None)], "id long, title string, summary string, content string")
    out = {r["id"]: r["brief"] for r in summarize.summaries(df, "id").collect()}
    assert out[1].startswith("The city council") and out[2] == "Title" and out[3] == ""
    c = one(spark, answers.citations(F.col("t"), F.lit(2)), t="Up [1], down [3] and [2][1].")
    assert c["valid"] == [1, 2] and c["invalid"] == ["[3]"] and "[3]" not in c["text"]
    none = spark.createDataFrame([], "place int, title string, source_name string, brief string, outlets array<string>")
    assert answers.extractive_answer(none, "q").first()["cited"] == []


def test_interests_and_sections(spark):
    who = interests.parse_interests("AI, machine learning and some linux news; ai")
    assert [i.label for i in who] == ["Ai", "Linux"] and who[0].literals == ["AI", "machine learning"]
    rows = [(i, f"Linux kernel release number{i}", "", "", ["linux"], [], f"s{i % 2}", "", f"u{i}", False, []) for i in range(8)]
    df = spark.createDataFrame(rows, "id long, title string, summary string, content string, topics array<string>, entities array<string>, source_id string, cluster_id string, canonical_url string, is_opinion boolean, framing array<string>").withColumn("t", F.timestamp_seconds(F.lit(1000)))
    done = briefing.sections(briefing.grouped(briefing.ranked(df, who, F.timestamp_seconds(F.lit(2000)), F.col("t"))), who).collect()
    assert {r["section"] for r in done} == {"Linux"} and len(done) <= 4


def test_state(spark):
    f = spark.createDataFrame([("a", 1, "ok", "e1"), ("a", 2, "error", None), ("a", 3, "error", None), ("b", 1, "error", None), ("c", 1, "not-modified", None)], "source_id string, s int, status string, etag string").withColumn("fetched_at", F.timestamp_seconds("s"))
    st = {r["source_id"]: (r["failures"], r["etag"]) for r in state.feed_state(f).collect()}
    assert st == {"a": (2, "e1"), "b": (1, None), "c": (0, None)}
    assert [r["streak"] for r in state.feed_runs(f).where("source_id = 'a'").orderBy("s").collect()] == [0, 1, 2]
    cols = "id long, canonical_url string, title string, summary string, content string, published_at string, cluster_id string"
    old = spark.createDataFrame([(1, "u1", "old", "long summary", "c", None, "k"), (2, "u2", "stay", "", "", "d", "")], cols)
    new = spark.createDataFrame([(3, "u1", "new", "s", "longer", "p", ""), (4, "u3", "in", "", "", None, "z")], cols)
    got = {r["canonical_url"]: r for r in state.upsert_articles(old, new).collect()}
    assert got["u1"][:7] == (1, "u1", "new", "long summary", "longer", "p", "k") and [got[k]["change"] for k in ("u1", "u2", "u3")] == ["updated", "kept", "inserted"]


def test_stream_batches_are_exactly_once(spark, tmp_path):
    from pressloom.streaming import ingest

    source, stored = tmp_path / "in", str(tmp_path / "out")
    for k, rows in enumerate(([("a", 1), ("b", 2), ("a", 3)], [("b", 4), ("c", 5)])):
        spark.createDataFrame(rows, "key string, n int").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("key string, n int").parquet(str(source))
        ingest.run_batches(stream, ingest.ingest_step(stored, "key"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["key"] for r in spark.read.parquet(stored).collect()) == ["a", "b", "c"]


@pytest.mark.parametrize("files", [1, 3])
def test_streams_replay_tables_of_one_file_and_of_folders(spark, tmp_path, files):
    from pressloom.plans.registry import QUERIES

    rows = [("a", 1, "ok", "e1"), ("a", 3, "error", None), ("a", 2, "error", None), ("a", 2, "error", None), ("b", 1, "error", None), ("b", 2, "ok", "e2")]
    f = spark.createDataFrame(rows, "source_id string, s int, status string, etag string").withColumn("fetched_at", F.timestamp_seconds("s"))
    if files == 1:
        f.coalesce(1).write.parquet(str(tmp_path / "w"))
        next((tmp_path / "w").glob("part-*")).rename(tmp_path / "raw_feeds.parquet")
    else:
        f.repartition(files, "s").write.parquet(str(tmp_path / "raw_feeds.parquet"))
    got = {r["source_id"]: (r["failures"], r["last_status"]) for r in QUERIES["stream_feed_states"](spark, str(tmp_path)).collect()}
    assert got == {"a": (2, "error"), "b": (0, "ok")}


def test_library_stands_without_the_llm_package(spark):
    import ast
    import pathlib

    root = pathlib.Path(__file__).parents[1] / "pressloom"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            names = [n.module or "" for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.ImportFrom)]
            assert not any("llm" in n for n in names), path


def test_stories_of_frequent_words_and_many_copies(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rng.sample(words, 6)), ["Acme"] if i % 5 == 0 else [], rng.randrange(0, 200)) for i in range(150)] + [(1000 + i, "bridge closed after storm", [], 10) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, title string, entities array<string>, h int").withColumn("t", F.timestamp_seconds(F.col("h") * 3600))
    want = set()
    for a in rows:
        for b in rows:
            if a[0] < b[0] and abs(a[3] - b[3]) <= 48:
                x, y = set(a[1].split()) - {"after"}, set(b[1].split()) - {"after"}
                c = len(x & y) / min(len(x), len(y))
                if c >= 0.62 or c >= 0.42 and a[2] and a[2] == b[2]:
                    want.add((a[0], b[0]))
    assert {tuple(r) for r in cluster.story_pairs(df, "id", "title", "entities", F.col("t")).collect()} == want
    assert cluster.story_pairs(df.limit(0), "id", "title", "entities", F.col("t")).count() == 0


def test_block_keys_meet_within_the_distance(spark):
    rng = random.Random(4)
    for blocks in (8, 9, 10):
        masks = dedupe.block_masks(6, blocks)
        for _ in range(200):
            a = rng.getrandbits(60)
            b = a
            for i in rng.sample(range(60), 6):
                b ^= 1 << i
            assert any(a & m == b & m for m in masks)


def test_exact_duplicates_keep_the_richest(spark):
    rows = [(1, "u1", None, "h1", "short", "", None), (2, "u2", None, "h1", "much longer", "", None), (3, "u2", None, "", "x", "", None), (4, None, "u9", None, None, None, None), (5, None, None, None, None, None, None), (6, None, None, "", None, None, None)]
    df = spark.createDataFrame(rows, "id long, canonical_url string, url string, content_hash string, content string, summary string, published_at string")
    assert {tuple(r) for r in dedupe.exact_kept(df).collect()} == {(2, 1, 3), (4, 4, 1), (5, 5, 1), (6, 6, 1)}


def answer(url, headers):
    from pressloom.sources.fetch import Response

    if "boom" in url:
        raise OSError("no route")
    if headers.get("If-None-Match") == "e1":
        return Response(304)
    return {"https://a/404": Response(404), "https://a/empty": Response(200)}.get(url, Response(200, b"<rss/>", "e2"))


def test_fetching_never_fails(spark):
    import sys

    from pyspark import cloudpickle

    from pressloom.sources import fetch

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    sources = spark.createDataFrame([("a", "https://a/ok"), ("b", "https://a/404"), ("c", "https://a/empty"), ("d", "https://boom"), ("e", "https://a/known")], "id string, url string")
    known = spark.createDataFrame([("e", "e1", None)], "source_id string, etag string, last_modified string")
    out = {r["source_id"]: r for r in fetch.fetch(sources, known, answer, 2).collect()}
    assert {k: r["status"] for k, r in out.items()} == {"a": "ok", "b": "error", "c": "error", "d": "error", "e": "not-modified"}
    assert out["a"]["etag"] == "e2" and out["e"]["etag"] == "e1" and "no route" in out["d"]["error"]
