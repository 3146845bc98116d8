import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressloom.llm import boilerplate, caps, encoding, history, leakage, mixture, neardup, pii, truncation, words

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
FILLER = [f"word{i}" for i in range(400)]


def text(rng, n=60):
    return " ".join(rng.choices(FILLER, k=n))


def shingles(t, size):
    w = words.words(t)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute_pairs(rows, size, threshold):
    sets = {i: shingles(t, size) for i, t in rows}
    return {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def test_flat_words_are_the_words():
    texts = [None, "", "a_b Éa-1 ß", "x" * 300000, "tail\x00end", "İstanbul ok"]
    flat, offsets = words.flat_words(texts)
    assert list(offsets[1:] - offsets[:-1]) == [len(words.words(t and t.replace("\x00", " "))) for t in texts]
    assert words.word_hash("end") == int(flat[offsets[5] - 1])


def near_rows(seed=2):
    rng = random.Random(seed)
    rows = [(i, text(rng)) for i in range(40)]
    for i in range(40, 70):
        w = rng.choice(rows)[1].split()
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = "edit" + str(rng.random())
        rows.append((i, " ".join(w)))
    return [*rows, (70, rows[0][1]), (71, rows[0][1]), (72, None), (73, ""), (74, "two words")]


@pytest.mark.parametrize("size, threshold, bands", [(3, 0.5, 84), (5, 0.8, 24)])
def test_near_duplicates_match_brute_force(spark, size, threshold, bands):
    rows = near_rows()
    members, links = neardup.similar(spark.createDataFrame(rows, "id long, text string"), "id", "text", size=size, threshold=threshold, bands=bands)
    assert {tuple(r) for r in neardup.all_pairs(members, links).collect()} == brute_pairs([(i, t) for i, t in rows if t], size, threshold)


def test_near_duplicate_groups_and_empty(spark):
    rows = near_rows()
    out = {r["id"]: r for r in neardup.groups(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    assert out[70]["class_id"] == out[71]["class_id"] == out[0]["class_id"] == 0 and 72 not in out and 74 not in out
    assert neardup.groups(spark.createDataFrame([], "id long, text string"), "id", "text").count() == 0


def test_hot_group_of_copies(spark):
    rng = random.Random(4)
    hot = text(rng)
    rows = [(i, hot if i % 3 == 0 else text(rng)) for i in range(300)]
    out = neardup.groups(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    assert out.where("class_id = 0").count() == 100 and out.where("n_links > 0").count() == 0


@pytest.mark.parametrize("size, threshold, bands", [(3, 0.5, 84), (5, 0.8, 24)])
def test_near_duplicates_that_share_only_usual_shingles(spark, size, threshold, bands):
    rng = random.Random(6)
    base = text(rng).split()
    rows = [(i, text(rng)) for i in range(40)] + [(i, " ".join(base)) for i in range(40, 65)]
    own = int((len(base) - size + 1) * (1 - threshold) / threshold)  # added words that leave the overlap with the base at the threshold
    rows += [(i, " ".join(base + [f"own{i}x{k}" for k in range(rng.randrange(own // 3, own + 1))])) for i in range(65, 130)]
    members, links = neardup.similar(spark.createDataFrame(rows, "id long, text string"), "id", "text", size=size, threshold=threshold, bands=bands)
    want, got = brute_pairs(rows, size, threshold), {tuple(r) for r in neardup.all_pairs(members, links).collect()}
    assert got <= want and len(want) > 2000 and len(want - got) <= 0.005 * len(want)


def test_sketch_agrees_with_overlap():
    import numpy as np

    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = base[:200], base[100:]
    s = neardup.sketches(np.concatenate([a, b]), np.repeat([0, 1], [200, 200]), 2, 512)
    assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.08
    one = neardup.sketches(base[:1], np.array([0]), 2, 16)
    assert (one[0] != np.uint64(0xFFFFFFFFFFFFFFFF)).all() and (one[1] == np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_caps_match_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(3), rng.choice(["a", "a", "b", None]), rng.choice(["x", "y", "", None]), rng.choice([None, 0.5, rng.random(), float("nan")])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, run_no int, source_id string, author string, quality double").withColumn("rank", F.lit("clash"))
    levels = [caps.Level(("run_no", "source_id", "author"), most=4, free="author"), caps.Level(("run_no", "source_id"), share=0.1, scope=("run_no",))]
    got = {r["id"] for r in caps.within_caps(df.drop("rank"), "id", "quality", levels).where("kept").collect()}
    order = sorted(rows, key=lambda r: (r[4] is None or r[4] != r[4], -(r[4] or 0) if r[4] == r[4] else 0, r[0]))
    size = {k: -(-sum(r[1] == k for r in rows) // 10) for k in range(3)}
    kept, n1, n2 = [], {}, {}
    for r in order:
        if not r[3] or n1.get(r[1:4], 0) < 4:
            n1[r[1:4]] = n1.get(r[1:4], 0) + 1
            kept.append(r)
    final = set()
    for r in kept:
        if n2.get(r[1:3], 0) < size[r[1]]:
            n2[r[1:3]] = n2.get(r[1:3], 0) + 1
            final.add(r[0])
    assert got == final
    assert caps.within_caps(df.drop("rank").limit(0), "id", "quality", levels).count() == 0


def history_rows():
    rng = random.Random(8)
    rows = []
    for i in range(120):
        title = " ".join(rng.choices(FILLER[:60], k=rng.randrange(1, 9)))
        if i and rng.random() < 0.3:
            title = rows[rng.randrange(i)][4] or ""
            title = title + (" extra" if rng.random() < 0.5 else "")
        rows.append((i, i // 12, rng.choice([f"u{i}", f"u{i % 7}", None, ""]), rng.choice([f"h{i}", "h1", None, ""]), rng.choice([title, title, None]) if i % 9 == 0 else title))
    long = " ".join(FILLER[:50])
    return [*rows, (200, 3, "z", None, long), (201, 5, "y", None, long + " more"), (202, None, "z", None, long)]


def brute_history(rows):
    out = set()
    for a in rows:
        for b in rows:
            if a[1] is None or b[1] is None or a[1] >= b[1]:
                continue
            x, y = set(words.words(a[4])), set(words.words(b[4]))
            if (a[2] and a[2] == b[2]) or (a[3] and a[3] == b[3]) or (x and y and len(x & y) / len(x | y) >= 0.6):
                out.add((a[0], b[0]))
    return out


HISTORY = "id long, run_no long, canonical_url string, content_hash string, title string"


def test_history_matches_brute_force(spark, tmp_path):
    rows = history_rows()
    df = spark.createDataFrame(rows, HISTORY)
    want = brute_history(rows)
    assert {tuple(r) for r in history.repeats(df, str(tmp_path / "all")).collect()} == want
    old, new = df.where("run_no < 4"), df.where("run_no between 4 and 6")
    index = history.HistoryIndex(spark, str(tmp_path / "index")).build(old)
    ids = lambda low, high: {r[0] for r in rows if r[1] is not None and low <= r[1] <= high}
    assert {tuple(r) for r in index.probe(new).collect()} == {p for p in want if p[0] in ids(0, 3) and p[1] in ids(4, 6)}
    for _ in range(2):  # a batch that comes again changes nothing
        index.append(new, "4-6")
    last = df.where("run_no = 7")
    due = {p for p in want if p[1] in ids(7, 7)}
    assert {tuple(r) for r in history.HistoryIndex(spark, index.path).probe(last).collect()} == due
    assert {tuple(r) for r in index.accept(last, "7").collect()} == due
    stored = {r["id"] for r in spark.read.parquet(f"{index.path}/exact").where("batch = '7'").collect()}
    assert stored == {r[0] for r in rows if r[1] == 7} - {p[1] for p in due} - {r[0] for r in rows if r[1] == 7 and not (r[2] or r[3] or r[4])}
    assert history.repeats(df.limit(0), str(tmp_path / "none")).count() == 0


def test_history_reads_only_the_buckets_of_a_batch(spark, tmp_path):
    rows = [(i, 1, f"u{i}", None, None) for i in range(3000)]
    index = history.HistoryIndex(spark, str(tmp_path / "index")).build(spark.createDataFrame(rows, HISTORY), bucket_rows=60)
    batch = history.prepared(spark.createDataFrame([(9000, 2, "u5", None, None)], HISTORY))
    read = index._read("exact", index._placed(history._entries(batch), "key"))
    assert 0 < read.count() < 200


def test_counts_of_earlier_articles(spark, tmp_path):
    rows = history_rows()
    got = {r["article_id"]: tuple(r)[2:] for r in history.earlier_counts(spark.createDataFrame(rows, HISTORY), str(tmp_path / "i")).collect()}
    for b in rows:
        n = [0, 0, 0, 0]
        for a in rows:
            if a[1] is not None and b[1] is not None and a[1] < b[1]:
                x, y = set(words.words(a[4])), set(words.words(b[4]))
                n[0] += bool(a[2]) and a[2] == b[2]
                n[1] += bool(a[3]) and a[3] == b[3]
                n[2] += bool(x) and x == y
                n[3] += bool(x and y) and x != y and len(x & y) / len(x | y) >= 0.6
        assert got[b[0]] == tuple(n), b


def test_repeated_lines(spark):
    rng = random.Random(9)
    body = lambda: text(rng, 20)
    rows = [(i, "s", f"By Ann Lee{i}, city desk\n{body()}\n\n© 20{i + 10} The Post – reproduction prohibited\nSHARE THIS STORY NOW" if i % 2 else f"{body()}\n(c) {i} X\nShare  this story now") for i in range(12)]
    rows += [(20, "t", "Share this story now"), (21, "s", None), (22, "s", ""), (23, None, "Share this story now"), (24, "s", "Share this story now\nShare this story now")]
    df = spark.createDataFrame(rows, "id long, source string, content string")
    counts: dict = {}
    for i, s, t in rows:
        for line in {boilerplate.same_line(x) for x in (t or "").split("\n")} - {""}:
            if s:
                counts.setdefault((s, line), set()).add(i)
    want = {(i, k) for i, s, t in rows if s for k, x in enumerate((t or "").split("\n"), 1) if boilerplate.same_line(x) and len(counts[s, boilerplate.same_line(x)]) >= 5}
    assert {(r["id"], r["line_no"]) for r in boilerplate.repeated_lines(df, "id", "source", "content", exact=True).collect()} == want
    clean = {r["id"]: r for r in boilerplate.without_repeated_lines(df, "id", "source", "content").collect()}
    assert clean[21]["content"] is None and clean[24]["content"] == "" and "By Ann" not in clean[1]["content"] and len(clean) == len(rows)


def test_clusters_are_built_only_where_they_count(spark, monkeypatch):
    cities = ["ulm", "bonn", "kiel", "jena", "hof", "trier", "graz", "linz", "bern", "genf", "lyon", "nancy"]
    rows = [(i, "s", f"own line {c}\n{c} desk of our paper holds all rights to this text and its pictures\nShare this story") for i, c in enumerate(cities)]
    df, stored, real = spark.createDataFrame(rows, "id long, source string, content string"), {}, boilerplate.spool
    monkeypatch.setattr(boilerplate, "spool", lambda x, name: stored.setdefault(name, real(x, name)))
    lines = lambda **k: {(r["id"], r["line_no"]) for r in boilerplate.repeated_lines(df, "id", "source", "content", **k).collect()}
    assert lines(exact=True) == {(i, 3) for i in range(12)} and set(stored) == {"lines"} and "bands" not in stored["lines"].columns
    stored.clear()
    assert lines() == {(i, k) for i in range(12) for k in (2, 3)} and set(stored) == {"lines", "classes", "alike"}
    stored.clear()
    assert lines(threshold=1.0) == {(i, 3) for i in range(12)}


def test_formulaic_lines_of_a_large_source_stay(spark):
    rng = random.Random(14)
    names = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(400)]
    formula = lambda i: "The {} of {} met the {} and {} to talk about the {} on day ".format(*rng.choices(names, k=5)) + str(i)
    rows = [(i, "s", f"{formula(i)}\nContact the desk of our paper in {['Ulm', 'Bonn', 'Kiel'][i % 3]} for all rights to this text and its pictures") for i in range(1500)]
    out = {r["id"]: r for r in boilerplate.without_repeated_lines(spark.createDataFrame(rows, "id long, source string, content string"), "id", "source", "content").collect()}
    assert all(r["content"].startswith("The ") and "Contact" not in r["content"] for r in out.values())


def test_masks():
    assert boilerplate.masked("Der Vorstand der Gesellschaft plant eine Fabrik") == "Der Vorstand der Gesellschaft plant eine Fabrik N N N N"
    assert boilerplate.masked("By Ann Lee, 12 March 2024") == "By N 0 0 0 N N N N"


def test_truncation(spark):
    ends = ["The council met in the old town hall on Monday.", "Sales rose by nine percent in the last quarter.", "Nobody asked the people who use the harbor."]
    rows = [(i, "s", f"Title {i}", " ".join(ends[(i + k) % 3] for k in range(3)), "") for i in range(60)]
    rows += [(100, "s", "T", "Sales rose by nine percent in the…", None), (101, "s", "T", "Nobody asked the people who u", "Ends with &am"), (102, "s", "Only a headline", "Only a headline", "  "), (103, None, "T", "Sales rose by nine percent in the last quarter. — The Post", "x" * 50000 + ".")]
    df = spark.createDataFrame(rows, "id long, source_id string, title string, summary string, content string")
    out = {(r["article_id"], r["field_name"]): r for r in truncation.truncated(df).collect()}
    assert {k for k, r in out.items() if r["is_cut"]} == {(100, "summary"), (101, "summary"), (101, "content")}
    assert (102, "content") not in out and (100, "content") not in out
    assert truncation.truncated(df.limit(0)).count() == 0
    assert truncation.left_open("he said “a (b") == "“(" and truncation.left_open('"a" (b)') == ""


def test_ends_that_only_look_broken():
    for t in ("Inflation rose by 5%", "Shares of AT&T", "Head of R&D", "https://a.example/x?y=1&z"):
        assert not truncation.broken(t), t
    for t in ("Caf&eacut", "a &am", "a &#12", "see /a%20b%2", "x \\u00e", "<a href='x"):
        assert truncation.broken(t), t
    long = "One. " + "word " * 3000 + "end"
    assert truncation.last_sentence(long) == long[5:] and truncation.last_sentence("A. B") == "B"


def test_truncation_inside_an_open_quote(spark):
    whole = "The council met in the old town hall on Monday."
    cut = ["The mayor said: “We will build it. We start in May.", "Er sagte: „Wir bauen. Im Mai.", "It rose (as in May. Nobody knew why.", 'He said: "We go. We stay.', "See <a href='x. Then more.", "The mayor said: “We will build it. We meet on Monday in the old town hall"]
    fine = ["He said: „Wir bauen.“ Then he left.", 'A 5" pipe burst.', "It was p < 5 then.", "“One.” “Two.”", "Fun :( and over.", "lieÃŸ â€œcan halt it.", "Item 1) is done.", '"Yes, in 1990" he said.', "»Wir bauen.« Dann ging er.", "« Oui », dit-il.", "“First paragraph without an end.\nLast one.”"]
    rows = [(i, "s", "T", t, whole) for i, t in enumerate(cut + fine + [whole] * 40)]
    out = truncation.truncated(spark.createDataFrame(rows, "id long, source_id string, title string, summary string, content string")).where("is_cut")
    assert {(r["article_id"], r["field_name"]) for r in out.collect()} == {(i, "summary") for i in range(len(cut))}


def test_encoding_round_trips(spark):
    rng = random.Random(10)
    clean = ["Le café près de la forêt était fermé", "Die Straße über die Brücke für Fußgänger", "“Nobody asked,” she said — it’s £5", "Город у реки закрыли на ремонт"]
    pool = [" ".join(rng.choices(clean, k=3)) for _ in range(300)]
    garble = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("cp1252", "cp850")]
    bad = {}
    for k, (w, r) in enumerate(garble):
        source = clean[k % 3]
        bad[1000 + k] = (source, source.encode(w, "ignore").decode(r, "ignore"))
    rows = [(i, t) for i, t in enumerate(pool)] + [(i, b) for i, (_, b) in bad.items()] + [(2000, "Die Stra?e"), (2001, "caf� noir"), (2002, None), (2003, ""), (2004, "Why? Because.")]
    out = {r["id"]: r for r in encoding.garbled(spark.createDataFrame(rows, "id long, content string"), "id", ["content"]).collect()}
    assert out.keys() == {*bad, 2000, 2001}
    assert out[1000]["restored"] == bad[1000][0] and out[1002]["restored"] == bad[1002][0] and out[2001]["lost"]
    assert encoding.garbled(spark.createDataFrame([], "id long, content string"), "id", ["content"]).count() == 0


def test_lost_characters_wherever_they_stand(spark):
    bad = ["Das M??rchen vom See", "?ber den Fluss", "Un caf? noir", "????? ? ????", "Stra?e, siehe https://a.example/b?c=d", "Stra?e und/oder?", "Stra?e/Br?cke", "a \ufffd b", "???"]
    fine = ["Why? Because.", "See https://a.example/b?c=d and a.example/x?y", "and/or? Both.", "“Why?” she said", "Pourquoi ? Parce que", "Really?! Yes", "/search?q=x", "Really?Yes, he said", "", None]
    rows = [(i, t) for i, t in enumerate(bad + fine)] + [(1000 + i, "Die Stra?e am See") for i in range(200)] + [(2000 + i, "Die Straße am See") for i in range(400)]
    out = {r["id"] for r in encoding.garbled(spark.createDataFrame(rows, "id long, content string"), "id", ["content"]).where("lost").collect()}
    assert out == {*range(len(bad)), *range(1000, 1200)}


def test_leaks_with_a_word_inserted_or_dropped(spark):
    rng = random.Random(12)
    items = [(i, " ".join(rng.sample(FILLER, 16))) for i in range(40)]
    docs, want = [], {}
    for i, (_, t) in enumerate(items):
        w = t.split()[2:14]
        at = rng.randrange(2, 10)
        w[at : at + i % 2] = [] if i % 2 else ["other"]
        docs.append((i, " ".join(["aa"] * 5 + w + ["bb"] * 5)))
        want[i] = (1, 5)
    docs.append((90, items[0][1]))
    out = leakage.leaks(spark.createDataFrame(docs, "d long, t string"), "d", "t", spark.createDataFrame(items, "i long, t string"), "i", "t").collect()
    got = {(r["doc_id"], r["item_id"]): (r["distance"], r["start_word"], r["n_windows"]) for r in out}
    assert got.pop((90, 0)) == (0, 0, 5)
    assert {k: v[:2] for k, v in got.items()} == {(i, i): v for i, v in want.items()}


def test_maximal_segments():
    assert encoding.segments([0, 1, 5, 6], [2.0, -1.0, 3.0, -5.0]) == [(0, 0), (5, 5)]
    assert encoding.segments([0, 1, 2], [2.0, -1.0, 3.0]) == [(0, 2)]


def test_leaks_match_brute_force(spark):
    rng = random.Random(11)
    items = [(i, text(rng, 30)) for i in range(12)] + [(50, None), (51, "too short")]
    docs = []
    for i in range(60):
        body = text(rng, 80).split()
        if i % 3 == 0:
            w = rng.choice(items[:12])[1].split()
            a, n = rng.randrange(15), rng.randrange(9, 16)
            body[20:20] = [x.upper() for x in w[a : a + n]]
        docs.append((i, ",  ".join(body)))
    docs += [(100, None), (101, ""), (102, items[0][1])]
    grams = lambda t: {tuple(w[k : k + 12]) for w in [words.words(t)] for k in range(len(w) - 11)}
    want = {(d, i) for d, t in docs for i, s in items if grams(t) & grams(s)}
    df, idf = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")
    found = leakage.leaks(df, "doc_id", "text", idf, "item_id", "item_text")
    assert {(r["doc_id"], r["item_id"]) for r in found.where("distance = 0").collect()} == want
    assert leakage.leaks(df, "doc_id", "text", idf.limit(0), "item_id", "item_text").count() == 0


def edited(rng, w, edits):
    for _ in range(edits):
        kind, at = rng.randrange(3), rng.randrange(len(w))
        w[at : at + (kind != 0)] = [f"new{rng.randrange(10**9)}"] if kind != 1 else []
    return w


@pytest.mark.parametrize("edits, least", [(0, 1.0), (1, 0.98), (2, 0.9)])
def test_search_recall_at_planted_edits(spark, edits, least):
    rng = random.Random(12 + edits)
    items = [(i, text(rng, 12)) for i in range(200)]
    docs = [(i, " ".join([text(rng, 10), *edited(rng, t.split(), edits), text(rng, 10)])) for i, t in items]
    out = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id long, item_text string"), "item_id", "item_text").collect()
    mine = {r["doc_id"]: r["distance"] for r in out if r["doc_id"] == r["item_id"]}
    assert len(mine) >= least * len(items) and all(d <= edits for d in mine.values())


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_edit_distances_match_brute_force(most):
    import numpy as np

    rng = random.Random(5)
    rows = [([rng.randrange(1, 5) for _ in range(6)], [rng.choice([0, 1, 2, 3, 4]) for _ in range(6 + 2 * most)]) for _ in range(300)]

    def brute(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return min(row)

    got, shift = leakage.near_distances(np.array([a for a, _ in rows], dtype=np.uint64), np.array([b for _, b in rows], dtype=np.uint64), most)
    assert got.tolist() == [min(most + 1, *(brute(a, b[most + o :]) for o in range(-most, most + 1))) for a, b in rows]
    assert all(brute(a, b[most + o :]) == d for (a, b), d, o in zip(rows, got, shift) if d <= most)


def test_template_windows_of_many_items(spark):
    shared = " ".join(FILLER[:14])
    items = [(i, f"{shared} own{i}") for i in range(300)]
    docs = [(i, f"x{i} {shared} y{i}") for i in range(50)]
    out = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id long, item_text string"), "item_id", "item_text")
    assert out.where("distance = 0").count() == 50 * 300


@pytest.mark.parametrize(
    "source, kind, start",
    [
        ("Write to ann.lee@post.example now", "email", 9),
        ("Write to ann (at) post [dot] example now", "email", 9),
        ("Call (202) 555-0123 now", "phone", 5),
        ("Call +44 (0)20 79460243.", "phone", 5),
        ("Call two zero two five five five zero one two three", "phone", 5),
        ("The number 969 08 6570 was", "id_number", 11),
        ("ID QQ 37 70 81 C here", "id_number", 3),
        ("at Apt 4B, 480 Ropewalk Terrace, Town.", "address", 3),
        ("at P.O. Box 157, Town", "address", 3),
        ("au 39 rue des Forgerons, 15717 Ville", "address", 3),
        ("lautet Lindengasse 22, 11450 Dorf", "address", 7),
        ("said Dr. Lena S. Gutopoyas today", "name", 9),
        ("holder Cabavabas, Wanda (x)", "name", 7),
    ],
)
def test_pii_found_at_its_place(source, kind, start):
    assert [(k, a) for a, _, k in pii.spans(source)] == [(kind, start)]


@pytest.mark.parametrize("source", ["Lot 202-5550 sold for $202,555", "Build 4.19.2025 fixes 174 faults; ticket QX-174-7", "The works on Cooper Street and Mill Road end on 2024-05-14.", "Section 12, Lane 4 of the depot", "Follow @desk for the 3-2 match", "Mount Senozecha and Lake Senozecha", "docket 387-0417-CV at 10:30", "", None])
def test_pii_decoys(source):
    assert pii.spans(source) == []


@pytest.mark.parametrize(
    "source, names",
    [
        ("Ask Clara Martin or Emma Thomas.", ["Clara Martin", "Emma Thomas"]), ("we met Hanna Frank", ["Hanna Frank"]), ("signed: Paul, Elsa", ["Paul, Elsa"]), ("we met Jean Paul Senozecha", ["Jean Paul Senozecha"]),
        ("then Anna Łodzina spoke", ["Anna Łodzina"]), ("then Lena Šutova spoke", ["Lena Šutova"]), ("then Dr. Rachel Cabavabas spoke", ["Rachel Cabavabas"]), ("with Frau Żaneta Ćirova", ["Żaneta Ćirova"]),
        ("it was late, said Priya Sharma on Monday", ["Priya Sharma"]), ("Wei Chen, 41, told the paper", ["Wei Chen"]), ("вчера Иван Петров сказал", ["Иван Петров"]), ("The Zedegedo said", []), ("Mayor Zedegedo said", []), ("Pafe Union said", []),
        ("with Clara, Martin and Paul", []), ("by Clara, Martin, Emma", []), ("Dr. Rachel said", []), ("Martin Group and Emma Street", []),
    ],
)
def test_names_beside_listed_names_titles_and_other_capitals(source, names):
    assert [source[a:b] for a, b, kind in pii.spans(source) if kind == "name"] == names


def test_kinds_of_names_are_learned(spark):
    rows = [(i, f"Foo{'abcdefghij'[i % 10]} Consortium said so, and Anna Berg{'abc'[i % 3]} left; Tom Okafor told us.") for i in range(100)] + [(200, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert "Consortium" in pii.learn_kinds(df, "text") and "Berga" not in pii.learn_kinds(df, "text")
    assert pii.occurrences(df, "doc_id", "text").where("pii_kind = 'name' and start_pos = 0").count() == 0


def test_other_scripts_stay_and_mixed_words_are_read():
    assert pii.shadow("Новости из Москвы")[0] == "Новости из Москвы" and pii.shadow("аnn@pоst.example")[0] == "ann@post.example"


def test_redaction_keeps_the_rest(spark):
    t = "Héllo — ask Lena Gutopoyas (lena @ post.example), 202-555-0107!"
    assert pii.redact(t) == "Héllo — ask [NAME] ([EMAIL]), [PHONE]!"
    rows = [(1, t), (2, None), (3, ""), (4, "word " * 20000 + "call 202-555-0107")]
    out = {r["doc_id"]: r for r in pii.redacted(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert out[2]["text"] is None and out[3]["n_found"] == 0 and out[4]["text"].endswith("[PHONE]")


def test_mixture_reaches_its_shares(spark):
    rng = random.Random(13)
    docs = [(i, rng.choice(["a", "a", "a", "b", "c", "other"]), rng.choice(["en", None, "DE"]), text(rng, rng.randrange(20, 80))) for i in range(1500)] + [(9000, "a", "en", None), (9001, None, "en", "x"), (9002, "b", "en", "")]
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.5, 3), ("c", 0.3, 2), ("empty", 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed = mixture.mixture(spark.createDataFrame(docs, "doc_id long, source string, lang string, text string"), targets, TOKENIZER).cache()
    rep = {r["source"]: r for r in mixture.report(mixed, targets).collect()}
    assert rep["empty"]["tokens"] == 0 and all(r["most_copies"] <= r["max_repeats"] for r in rep.values())
    assert all(abs(rep[s]["actual_share"] - w) < 0.02 for s, w in (("a", 0.2), ("b", 0.5), ("c", 0.3)))
    assert {r["doc_id"] for r in mixed.where("source is null").collect()} == set()
    none = spark.createDataFrame([], "doc_id long, source string, lang string, text string")
    assert mixture.mixture(none, targets, TOKENIZER).count() == 0


def test_mixture_rakes_to_given_marginals(spark):
    rng = random.Random(15)
    docs = [(i, rng.choice("ab"), rng.choice(["en", "en", "en", "de"]), rng.choice("xyz"), text(rng, 40)) for i in range(2000)]
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    wanted = {"lang": {"en": 0.5, "de": 0.5}, "topic": {"x": 0.6, "y": 0.2, "z": 0.2}}
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, kind string, text string")
    mixed = mixture.mixture(df, targets, TOKENIZER, tokens=150000, marginals=wanted, topic="kind").cache()
    assert all(abs(r["gap"]) < 0.05 for r in mixture.gaps(mixed, targets, wanted).collect())


def test_topics_are_learned(spark):
    rng = random.Random(16)
    pools = [[f"{p}{k}" for k in range(30)] for p in ("ship", "bank", "song")]
    rows = [(i, "en", " ".join(rng.choices(pools[i % 3], k=30))) for i in range(300)] + [(900, "en", None), (901, "xx", "")]
    model = mixture.learn_topics(spark.createDataFrame(rows, "doc_id long, lang string, text string"), each=3)
    got = model.of([t for _, _, t in rows], [x for _, x, _ in rows])
    assert got[-2:] == ["other", "other"] and all(len({got[i] for i in range(k, 300, 3)}) == 1 for k in range(3)) and len(set(got[:3])) == 3


def test_topics_come_from_all_texts(spark):
    rng = random.Random(17)
    pools = [[f"{p}{k}" for k in range(30)] for p in ("ship", "bank", "song")]
    rows = [(i, "en", " ".join(rng.choices(pools[i % 3], k=12))) for i in range(4000)] + [(9000, None, "ship1"), (9001, "pt", "navio"), (9002, "en", "?")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model, again = (mixture.learn_topics(x, each=3) for x in (df, df.repartition(7, F.rand(3))))
    size, places, n = mixture.bags([t for _, _, t in rows[:4000]])
    seen = np.bincount(places, minlength=mixture.PLACES)
    assert np.allclose(model.weight["en"], np.where(2 * seen >= 4000, 0, np.log(4001 / (1 + seen))))
    v, flat = mixture.units(size, places, n, model.weight["en"]), np.zeros((4000, mixture.PLACES), np.float32)
    flat[np.repeat(np.arange(4000), size), places] = v
    assert np.allclose(mixture.cosines(size, places, v, model.centres["en"]), flat @ model.centres["en"].T, atol=1e-5)
    near = (flat @ model.centres["en"].T).argmax(axis=1)
    means = np.stack([flat[near == k].sum(axis=0) for k in range(3)])
    assert np.allclose(model.centres["en"], means / np.linalg.norm(means, axis=1, keepdims=True), atol=1e-5)
    assert np.array_equal(model.centres["en"], again.centres["en"])
    assert model.of(["ship1", "navio", None], ["en", "pt", "en"])[1:] == ["other", "other"]
