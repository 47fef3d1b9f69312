"""Nearest neighbours, page text, quotes, host reputation, and the pipeline."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import htmlcut
from factloom.llm.annsearch import encode, fit_codebooks, nearest
from factloom.llm.hostrep import RULES, judge, labels_of
from factloom.llm.common import hashed_sample
from factloom.llm.htmlcut import blocks_of, extract, main_text, min_cut
from factloom.llm.htmlcut import _START as WEIGHTS
from factloom.llm.quotes import reply_order

# -- vectors ----------------------------------------------------------------------------------------


def exact(rows, top=20, every=20):
    best = {}
    pool = [(i, np.array(v, np.float64)) for i, v in rows]
    for q, x in pool:
        if q % every == 0:
            scored = sorted(((-float(x @ y), i) for i, y in pool if i != q))[:top]
            best[q] = [(i, -s) for s, i in scored]
    return best


def test_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want = exact(rows)
    got = {}
    for r in nearest(spark, table).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.95
    score = {q: dict(v) for q, v in want.items()}
    assert all(abs(s - score[q][i]) < 1e-12 for q, v in got.items() for i, s in v if i in score[q])


def test_recall_by_codes_alone(spark):
    """Few candidates of many, so that what is found hangs on the codes."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = exact([(r.vec_id, r.embedding) for r in table.collect()])
    got = {}
    for r in nearest(spark, table, rerank=60).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = np.mean([len(got[q] & {i for i, _ in want[q]}) / 20 for q in want])
    assert 0.9 <= recall


def test_doubles_and_several_lengths(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.normal(size=3) + 1e-9]) for k in range(120)] + [(1_000 + k, [float(x) for x in rng.normal(size=7) * 1e-170]) for k in range(50)]
    rows += [(3_000, [1.0, 2.0]), (3_020, [5.0] * 11)]
    df = spark.createDataFrame([(i, x) for i, x in rows], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in nearest(spark, df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = exact([x for x in rows if len(x[1]) == 3]) | exact([x for x in rows if len(x[1]) == 7])
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert all(math.isclose(a, b, rel_tol=1e-13) for (_, a), (_, b) in zip(got[q], want[q]))


def test_vector_edges(spark):
    rng = np.random.default_rng(1)
    v = lambda: [float(x) for x in rng.normal(size=4).astype(np.float32)]
    same = v()
    rows = [(k, v()) for k in range(60)] + [(100 + k, same) for k in range(45)]
    bad = [(200, None), (220, [0.0] * 4), (240, [1.0, None, 0.0, 0.0]), (260, [math.nan, 1.0, 1.0, 1.0]), (280, [math.inf, 1.0, 1.0, 1.0]), (300, [1.0, 2.0]), (320, []), (None, v())]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows + bad + rows[:3]], "vec_id long, embedding array<float>, rank int").repartition(4)
    got = {}
    for r in nearest(spark, df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = {q: [i for i, _ in hits] for q, hits in exact(rows).items()}
    assert got == want  # ties among the equal vectors go to the smaller ids
    assert nearest(spark, df.limit(0)).count() == 0
    assert nearest(spark, spark.createDataFrame(bad, "vec_id long, embedding array<float>").where("vec_id = 220")).count() == 0


def test_codes_get_nearer_with_more_codebooks():
    x = np.random.default_rng(2).normal(size=(800, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    errors = []
    for m in (1, 4, 8):
        books = fit_codebooks(x, codebooks=m, words=64)
        codes, decoded = encode(x, books)
        assert np.allclose(decoded, sum(books[k][codes[:, k]] for k in range(m)), atol=1e-4)
        errors.append(float(((x - decoded) ** 2).sum(1).mean()))
    assert errors[0] > errors[1] > errors[2]


# -- pages ------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var a = "</p><p>no";</script></head><body>
<div id="header"><a href="/">Home</a> <a href="/b">Blog</a></div><div class="cookie-notice">We use cookies. <button>OK</button></div>
<div class="content"><h1>My  title</h1><p>First long paragraph, with <a href=x>a l</a>ink and text &amp; &lt;b&gt; caf&eacute;.<p>Second paragraph here,<br>with some words. It goes on.
<ul><li>An item of the list that is text.<li>Another item, too.</ul><div class="ad">Buy now.</div><p>Third paragraph after the advert, with its words.</p></div>
<div class="comments"><h3>Comments</h3><p>I like this a lot, thanks for the article, really great stuff here.</p></div>
<aside>See also: <a>x</a></aside><form>Name <input> <select><option>a</select></form><noscript>Enable it.</noscript><footer>&copy; 2020 Someone</footer></body></html>"""
TEXT = "My title First long paragraph, with a link and text & <b> café. Second paragraph here, with some words. It goes on. An item of the list that is text. Another item, too. Third paragraph after the advert, with its words."


def test_main_text():
    assert main_text(PAGE, WEIGHTS) == TEXT
    assert main_text(None, WEIGHTS) == main_text("", WEIGHTS) == main_text("<nav><a>x</a></nav>", WEIGHTS) == ""


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "x", "<a \"" * 20_000, "<p>" + "word " * 100_000, "<div><p>Some words.</p></div><nav>x</nav>" * 2_000, "</p></div>" * 5_000, "<!-- never closed <p>x</p>", "<b><i>" * 5_000])
def test_odd_pages_end(page):
    main_text(page, WEIGHTS)


def test_pages_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in extract(spark, pages).collect()}
    import html
    import re

    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(" ".join(html.unescape(re.sub(r"</?b>", "", x)) for x in re.split(r"<(?!/?b>)[^>]*>", body)).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


P1 = "The council met on Tuesday evening to discuss the new bridge, which has been planned for several years."
P2 = "After two hours of debate the members voted in favour, although the cost remains a matter of dispute."
P3 = "Construction is expected to begin in spring, and traffic will be led around the old mill until then."
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li><li><a href="/w">Weather</a></li></ul>'
FOOT = '<div id="footer"><p>&copy; 2024 Example Press. <a href="/imprint">Imprint</a> <a href="/terms">Terms</a></p></div>'
HAND = {
    "no article tag": (f"<body><div class=top>{MENU}</div><div class=story><h1>Bridge approved</h1><p>{P1}</p><p>{P2}</p></div>{FOOT}</body>", f"Bridge approved {P1} {P2}"),
    "links between paragraphs of a plain div": (f'<div><p>{P1}</p><p><a href="/more">Read more</a></p><p>{P2}</p><p><a href="/sub">Subscribe now</a></p><p>{P3}</p></div>', f"{P1} {P2} {P3}"),
    "inline advert": (f'<div><p>{P1}</p><div class="advert">Buy the new vacuum cleaner now, only this week at half the price!</div><p>{P2}</p></div>', f"{P1} {P2}"),
    "a name that says there are no adverts": (f'<div class="post-ad-free"><p>{P1}</p><p>{P2}</p></div>', f"{P1} {P2}"),
    "one container for all": (f"<body>{MENU}<p>{P1}</p><p>{P2}</p><p>{P3}</p>{FOOT}</body>", f"{P1} {P2} {P3}"),
    "comments look like text": (f'<div id=main><p>{P1}</p><p>{P2}</p></div><div class="comments"><p>I do not think that this is a good idea, we need the old one.</p><p>{P3}</p></div>', f"{P1} {P2}"),
    "links within text": (f'<div><p>The council met <a href="/x">on Tuesday evening</a> to discuss the <a href="/y">new bridge</a>, planned for years.</p><p>{P2}</p></div>', f"The council met on Tuesday evening to discuss the new bridge, planned for years. {P2}"),
    "slashes at the end of values": (f"<div><a href=http://x.com/>Link text</a> <a href=/y/>Another one</a></div><div/><p>{P1}</p><p>{P2}</p></div>", f"{P1} {P2}"),
    "list and quote within the text": (f"<div class=content><h2>Plans</h2><p>{P1}</p><ul><li>The northern bank gets a new path for bicycles, too.</li><li>Trees are planted on both sides of the river.</li></ul><blockquote>{P2}</blockquote></div>{FOOT}", f"Plans {P1} The northern bank gets a new path for bicycles, too. Trees are planted on both sides of the river. {P2}"),
    "cookie notice and form": (f'<div class="cookie-consent"><p>We use cookies to give you the best experience on our site. By going on you agree.</p></div><form><p>Your name and your address, please.</p></form><main><p>{P1}</p><p>{P3}</p></main>', f"{P1} {P3}"),
    "table layout": (f"<table><tr><td>{MENU}</td><td><p>{P1}</p><p>{P2}</p></td></tr></table>", f"{P1} {P2}"),
    "related stories after the text": (f'<div class=body><p>{P1}</p><p>{P2}</p></div><div class="related"><h3>Related</h3><ul><li><a href="/1">Old mill reopens after long works</a></li><li><a href="/2">River path closed for the winter</a></li></ul></div>', f"{P1} {P2}"),
}


@pytest.fixture(scope="module")
def fitted(spark):
    return htmlcut.learn(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


@pytest.mark.parametrize("name", sorted(HAND))
def test_pages_made_by_hand(fitted, name):
    assert main_text(HAND[name][0], fitted) == HAND[name][1]


def test_pages_without_marks(fitted):
    """Every page of the table without the names of its parts: what blocks look like, and the cut, must do."""
    import duckdb

    right = kept = all_ = 0
    for (page,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        want = Counter(main_text(page, fitted).split())
        bare = re.sub(r'\s(class|id|role)="[^"]*"', "", re.sub(r"<(/?)(article|nav|footer|aside|header|form|main)\b[^>]*>", r"<\1div>", page))
        got = Counter(main_text(bare, fitted).split())
        right, kept, all_ = right + sum((want & got).values()), kept + sum(got.values()), all_ + sum(want.values())
    assert right / all_ > 0.99 and right / kept > 0.97


def test_a_slash_ends_no_element_and_anchors_are_no_links():
    (block,) = blocks_of("<p><a href=http://x.com/>Link text</a>")
    assert block.linked == 9
    (block,) = blocks_of('<p><a name="top"/>Plain text</p>')
    assert block.linked == 0


def test_samples_are_bounded_and_never_vanish(spark):
    """One id on all rows, and a table of which the sample is less than a millionth."""
    page = "<nav><a href=x>Menu</a></nav><main><p>Some words, and a stop.</p></main>"
    same = spark.range(100_000).select(F.lit(1).cast("long").alias("page_id"), F.lit(page).alias("html"))
    assert hashed_sample(same, ["page_id", "html"], 50, total=1, label="x").count() == 1
    other = spark.range(100_000).select(F.lit(1).cast("long").alias("page_id"), F.col("id").cast("string").alias("html"))
    assert hashed_sample(other, ["page_id", "html"], 50, total=100_000, label="x").count() == 50
    few = spark.range(3_000_000).select(F.col("id").alias("page_id"), F.lit("").alias("html"))
    assert 1 <= hashed_sample(few, ["page_id"], 2, total=3_000_000, label="x").count() <= 2
    assert not np.array_equal(htmlcut.learn(same, sample=50), WEIGHTS)  # learned from the one page that there is


def test_page_edges(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", PAGE, "x"), (3, "u", PAGE, "x"), (3, "u", PAGE, "x"), (4, "u", "just words, no tags.", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), r.n_chars) for r in extract(spark, df).collect())
    assert got == [("1", 0), ("2", 0), ("3", len(TEXT)), ("3", len(TEXT)), ("4", 20), ("None", len(TEXT))]
    assert extract(spark, df.limit(0)).count() == 0


def test_minimum_cut_is_minimal():
    rnd = random.Random(6)
    for _ in range(150):
        n = rnd.randint(1, 8)
        gain = [rnd.choice([-2.0, -1.0, 0.5, 1.5, 3.0]) for _ in range(n)]
        ties = [(a, b, rnd.choice([0.2, 1.0, 2.5])) for a in range(n) for b in range(a) if rnd.random() < 0.5]
        cost = lambda keep: sum(max(g, 0) for g, k in zip(gain, keep) if not k) + sum(max(-g, 0) for g, k in zip(gain, keep) if k) + sum(w for a, b, w in ties if keep[a] != keep[b])  # noqa: B023,E731
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(min_cut(gain, ties)) - best) < 1e-6


# -- quotes -----------------------------------------------------------------------------------------


def test_reply_order(spark):
    hello = "Hello there, how are you today?\n\nI have two questions about the plan."
    rows = [
        (1, 0, "a", hello, 1),
        (1, 1, "b", "> I have two  QUESTIONS about the plan\nAsk them, then.", 1),
        (1, 2, "c", "Something else entirely happened here.", 1),
        (1, 3, "d", "> > Hello there, how are you today?\n> > \n> > I have two questions about the plan.\n> Ask them, then.\nHere they are: why and how?", 1),
        (1, 4, "e", "> Nobody ever said this sentence before\nWhat?", 1),
        (1, 5, "f", ">Here they are: why and how?\r\nBecause.\r\n", 1),
        (2, 0, "a", "> I have two questions about the plan.\nNot in this conversation.", 1),
        (2, 1, "b", None, 1), (2, 1, "b", None, 1), (None, 0, "x", "> q", 1), (3, None, "x", "alone", 1), (4, 0, "x", "", 1),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, level int").repartition(3)
    got = reply_order(spark, df).collect()
    assert len(got) == len(rows)
    one = {r.turn: r for r in got if r.conv_id == 1}
    assert {t: r.parent_turn for t, r in one.items()} == {0: None, 1: 0, 2: 1, 3: 1, 4: 3, 5: 3}
    assert {t: r.quoted for t, r in one.items()} == {0: False, 1: True, 2: False, 3: True, 4: False, 5: True}
    assert one[3].n_linked_levels == 2 and one[3].n_passages == 2 and one[3].text == "Here they are: why and how?"
    assert one[5].text == "Because." and one[0].text == hello
    order = [r.turn for r in sorted(one.values(), key=lambda r: r.reply_order)]
    place = {t: k for k, t in enumerate(order)}
    assert all(place[r.parent_turn] < place[t] for t, r in one.items() if r.parent_turn is not None)
    assert {(r.turn, r.parent_turn, r.text) for r in got if r.conv_id == 2} == {(0, None, "Not in this conversation."), (1, 0, "")}
    assert reply_order(spark, df.limit(0)).count() == 0


def brute_parents(rows):
    """Turn -> parent by comparing every quoted part with every earlier message of the conversation."""
    import re

    norm = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))

    def parts(text):
        lines = [x for x in text.split("\n") if len(norm(x).split()) >= 3]
        return {p for p in map(norm, [text, *re.split(r"\n\s*\n", text), *lines]) if p}

    said, out = {}, {}
    for turn, text in rows:
        own, runs = [], []
        for line in text.split("\n"):
            m = re.match(r"^[ \t]*>[ \t>]*", line)
            level = m[0].count(">") if m else 0
            (own if not level else runs).append((level, line[m.end() :]) if level else line)
        merged = []
        last = None
        for line in text.split("\n"):
            m = re.match(r"^[ \t]*>[ \t>]*", line)
            level = m[0].count(">") if m else 0
            if level and level == last:
                merged[-1][1] += "\n" + line[m.end() :]
            elif level:
                merged.append([level, line[m.end() :]])
            last = level
        hits = {}
        asked = {(level, p) for level, t in merged for p in parts(t)}
        for level, p in asked:
            target = max((t for t, offered in said.items() if p in offered), default=None)
            if target is not None:
                hits[level, target] = hits.get((level, target), 0) + len(p)
        out[turn] = min(hits, key=lambda k: (k[0], -hits[k], -k[1]))[1] if hits else max(said, default=None)
        said[turn] = parts("\n".join(own)) if "\n".join(own).strip() else set()
    return out


def test_parents_equal_brute_force(spark):
    rnd = random.Random(8)
    rows, want = [], {}
    for conv in range(12):
        texts = []
        for turn in range(rnd.randint(1, 9)):
            lines = [" ".join(rnd.choice(["red", "blue", "sun", "moon", "tree"]) for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(1, 3))]
            quoted = []
            if texts and rnd.random() < 0.6:
                quoted = ["> " + x for x in rnd.choice(texts).split("\n")]
            texts.append("\n".join(quoted + lines))
            rows.append((conv, turn, "r", texts[-1]))
        want[conv] = brute_parents(list(enumerate(texts)))
    got = {}
    for r in reply_order(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got.setdefault(r.conv_id, {})[r.turn] = r.parent_turn
    assert got == want


@pytest.mark.parametrize("bucket", [7, 1 << 14])
def test_deeply_nested_branches(spark, monkeypatch, bucket):
    from factloom.llm import quotes

    monkeypatch.setattr(quotes, "BUCKET", bucket)
    rnd = random.Random(2)
    n, rows, parent = 600, [], {}
    for t in range(n):
        to = t - 2 if t % 2 and t > 2 else rnd.randrange(t) if t > 2 and rnd.random() < 0.3 else None
        parent[t] = to if to is not None else t - 1 if t else None
        rows.append((1, 3 * t, "u", (f"> saying number {to} here\n" if to is not None else "") + f"saying number {t} here"))
    branch, path, depth, want = {}, {None: ""}, {None: 0}, {}
    for t in range(n):
        branch[t] = t if parent[t] is not None and parent[t] != t - 1 else branch.get(t - 1)
        if branch[t] == t:
            up = branch[parent[t]]
            path[t], depth[t] = path[up] + f"{3 * parent[t]:020d}/{3 * t:020d}/", depth[up] + 1
        want[3 * t] = (None if parent[t] is None else 3 * parent[t], depth[branch[t]], path[branch[t]] + f"{3 * t:020d}")
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.turn: (r.parent_turn, r.branch_depth, r.reply_order) for r in reply_order(spark, df).collect()}
    assert got == want and max(depth.values()) > 200


# -- hosts ------------------------------------------------------------------------------------------


def test_rules_and_hosts(spark):
    urls = {
        1: "https://A.Example.NET/en/x?y", 2: "http://b.net/", 3: "http://b.net", 4: "https://example.com/de/1#t", 5: "https://www.example.com/fr/", 6: "http://x.org/fr/a", 7: "no scheme", 8: None,
        9: "x://notexample.net/en/", 10: "http://example.net/en/?q=http://z", 11: "http://h.example.org?x=/fr/", 12: "ftp://ÄB.org:80/fr/",
    }
    df = spark.createDataFrame([(k, u, 0) for k, u in urls.items()] + [(None, "http://b.net/", 0)], "page_id long, url string, n int")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(spark, df, none).collect()}
    assert got == {
        1: ("a.example.net", "/en/x", "example.net/en/", "allow"), 2: ("b.net", "/", "net/", "block"), 3: ("b.net", "", None, "allow"), 4: ("example.com", "/de/1", "example.com/de/", "block"),
        5: ("www.example.com", "/fr/", None, "allow"), 6: ("x.org", "/fr/a", "org/fr/", "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("notexample.net", "/en/", "net/", "block"),
        10: ("example.net", "/en/", "example.net/en/", "allow"), 11: ("h.example.org", "", None, "allow"), 12: ("Äb.org:80", "/fr/", None, "allow"), None: ("b.net", "/", "net/", "block"),
    }
    assert judge(spark, df.limit(0), none).count() == 0 and len(RULES) == 4


def test_reputation_follows_outcomes_and_shrinks(spark):
    pages = [(k, f"http://bad.evil.com/{k}") for k in range(60)] + [(100 + k, f"http://h{k}.good.com/") for k in range(60)] + [(300, "http://new.evil.com/"), (301, "http://new.good.com/"), (302, "http://once.good.com/")]
    out = [(k, True) for k in range(60)] + [(100 + k, k % 10 == 0) for k in range(60)] + [(302, True), (302, None), (None, True), (999, True)]
    df, outcomes = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(out, "page_id long, bad boolean")
    got = {r.page_id: r for r in judge(spark, df, outcomes, rules=()).collect()}
    assert got[0].verdict == "block" and got[100].verdict == got[301].verdict == "allow"
    assert got[302].verdict == "allow"  # one bad page does not condemn a host of a good domain
    assert got[300].posterior > got[301].posterior  # an unseen host takes after its domain
    assert 0 <= got[0].low <= got[0].posterior <= 1


def test_labels(spark):
    rows = [(1, 0, 0), (2, 1, 1), (3, 1, 0), (4, None, None), (5, None, 1)]
    got = {r.page_id: r.bad for r in labels_of(spark.createDataFrame(rows, "doc_id long, quality int, toxic int")).collect()}
    assert got == {1: True, 2: True, 3: False, 4: None, 5: True}


def test_repeated_pages_and_outcomes(spark):
    """Outcomes of one page count once, bad if any is; every row of a page that repeats is judged, and counts."""
    pages = [(1, "http://a.com/"), (1, "http://a.com/"), (2, "http://b.com/"), (None, None), (None, "http://a.com/")]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, host string, bad int")
    out = [(1, False), (1, True), (1, None), (2, False), (None, True)]
    got = sorted((str(r.page_id), r.host, r.verdict, r.posterior) for r in judge(spark, df, spark.createDataFrame(out, "page_id long, bad boolean"), rules=()).collect())
    once = judge(spark, df.where("page_id IS NOT NULL"), spark.createDataFrame([(1, True), (2, False)], "page_id long, bad boolean"), rules=())
    assert [x[:2] for x in got] == [("1", "a.com"), ("1", "a.com"), ("2", "b.com"), ("None", ""), ("None", "a.com")]
    assert {(i, p) for i, _, _, p in got if i != "None"} == {(str(r.page_id), r.posterior) for r in once.collect()}


def test_very_long_messages(spark):
    body = "\n".join(f"line {k} of a very long message" for k in range(20_000))
    quote = "\n".join(f"> line {k} of a very long message" for k in range(5_000, 15_000))
    rows = [(1, 0, "a", body), (1, 1, "b", "short"), (1, 2, "a", quote + "\nI agree."), (2, 0, "a", "word " * 200_000), (2, 1, "b", "> " + "word " * 200_000 + "\nyes")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, branch string")
    got = {(r.conv_id, r.turn): r for r in reply_order(spark, df).collect()}
    assert (got[1, 2].parent_turn, got[1, 2].quoted, got[1, 2].text) == (0, True, "I agree.")
    assert (got[2, 1].parent_turn, got[2, 1].quoted, got[2, 1].text) == (0, True, "yes") and len(got[1, 0].text) == len(body)
