"""Language ID, licenses, decontamination: held-out accuracy and brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import langid, licenses
from factloom.llm.decontam import align, leaks, without_leaks
from factloom.llm.licenses import PHRASES, TEMPLATES, scan

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


# -- language ---------------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 ... \n", "de"), (None, "the house and the garden of the old man", None), (4, "the house and garden", "en"), (4, "the house and garden", "en"), (6, "²½", "en")]
    rows += [(k, "the house and the garden that was with them", "en") for k in range(10, 60)] + [(k, "das haus und der garten die nicht sein", "de") for k in range(60, 110)]
    rows += [(k, "la maison et le jardin qui est dans", "fr") for k in range(110, 160)] + [(200, "the " * 400_000, None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, score string")
    got = langid.identify(spark, df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (1, 2, 3, 6)] == ["und"] * 4 and by[1].score == 0
    assert by[None].lang_pred == "en" and by[200].lang_pred == "en" and not by[None].held_out
    assert by[70].lang_pred == "de" and by[120].lang_pred == "fr"
    assert langid.identify(spark, df.limit(0)).count() == 0
    none = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(spark, none).collect()} == {"und"}


def test_prediction_does_not_see_lang_or_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.learn(docs)
    rows = docs.limit(50).collect()
    x = np.array([langid.features(np.frombuffer(r.text.encode(), np.uint8)) for r in rows if r.text])
    again, scores = langid.predict(model, x)
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark, docs).collect()}
    assert [got[r.doc_id] for r in rows if r.text] == again and (scores <= 1).all()


def test_pieces_of_long_texts_count_like_the_whole(monkeypatch):
    raw = np.frombuffer(("Über die Häuser und Gärten, 12 " * 50).encode(), np.uint8)
    whole = langid.features(raw)
    monkeypatch.setattr(langid, "_PIECE", 100)
    assert np.allclose(whole, langid.features(raw), atol=1e-6)


def test_every_language_is_learned(spark):
    rnd = random.Random(3)
    rows = [(6 * k + i, " ".join(f"{rnd.choice('abcdefgh')}q{k:x}z" for _ in range(5)), f"x{k}") for k in range(205) for i in range(6)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {n for m in model["members"].values() for n in m} == {f"x{k}" for k in range(205)}


def test_repeated_rows_do_not_crowd_out_a_language(spark):
    texts = {lang: [f"{word} {k} " * 5 for k in range(12)] for lang, word in (("aa", "zarim"), ("bb", "quolux"), ("cc", "thebby"))}
    rows = [(k * 3 + j, t, lang) for j, (lang, own) in enumerate(sorted(texts.items())) for k, t in enumerate(own)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    many = spark.range(50_000).select(F.lit(1_001).cast("long").alias("doc_id"), F.lit("zarim 7 " * 5).alias("text"), F.lit("aa").alias("lang"))
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark, df.unionByName(many), sample=30).distinct().collect()}
    assert all(got[i] == lang for i, _, lang in rows)


def test_ties_and_texts_without_features(spark):
    """Languages that cannot be told apart get the same answer every time, in the order of their names; scores stay within 0 and 1."""
    rows = [(k, "same words here", ("xx", "yy")[k % 2]) for k in range(40)] + [(100, "\u4e00", None), (101, "1 2 3", "xx"), (102, "z" * 3_000_000, "xx")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    one, two = ([(r.doc_id, r.lang_pred, r.score) for r in langid.identify(spark, d).orderBy("doc_id").collect()] for d in (df, df.repartition(7)))
    assert one == two and len({x[1] for x in one if x[0] < 40}) == 1
    assert all(0 <= x[2] <= 1 for x in one) and {x[1] for x in one if x[0] == 101} == {"und"}


def test_language_sample_reaches_the_driver_packed(spark, monkeypatch):
    """Whole vectors, in less than half of their bytes: the driver's memory is the least there is."""
    docs, sent = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), []
    whole = type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda self: sent.append(whole(self)) or sent[-1])
    model = langid.learn(docs)
    got = {r["doc_id"]: r["x"] for r in sent[0].to_pylist()}
    assert len(got) > 50 and sent[0].nbytes < len(got) * langid.FEATURES
    texts = {r.doc_id: r for r in docs.where("text IS NOT NULL AND lang IS NOT NULL").collect()}
    x = np.array([langid.features(np.frombuffer(texts[i].text.encode(), np.uint8)).astype(np.float16) for i in sorted(got)], np.float32)
    want = langid.fit(np.hstack([x, np.ones((len(x), 1), np.float32)]), [texts[i].lang for i in sorted(got)])
    assert model["members"] == want["members"] and np.allclose(model["family"], want["family"], rtol=1e-3, atol=1e-4)


# -- licenses ---------------------------------------------------------------------------------------


def brute_scan(text):
    w = words(text)
    spots = [(i, label) for phrase, label in PHRASES.items() for p in [phrase.split()] for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    labels, score, n = {label for _, label in spots}, 1.0 if spots else 0.0, 0
    for line in (text or "").split("\n"):
        have = set(words(line))
        held = {}
        for k, (label, t) in enumerate(TEMPLATES):
            own = set(words(t))
            if 10 * len(own & have) >= 9 * len(own):
                held[k] = (label, len(own & have) / len(own))
        for k, (label, share) in held.items():
            if not any(set(words(TEMPLATES[k][1])) < set(words(TEMPLATES[u][1])) for u in held):
                labels, score, n = labels | {label}, max(score, share), n + 1
    starts = [i for i, _ in spots]
    return len(w), len(spots), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in spots})), ",".join(sorted(labels)), score, n


def test_scan_equals_brute_force(spark, sf_dir):
    rnd = random.Random(2)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for k in range(60):
        lines = []
        for _ in range(rnd.randint(1, 4)):
            w = rnd.choice(TEMPLATES)[1].split() + [rnd.choice(["the", "license", "foo", "MIT"]) for _ in range(rnd.randint(0, 6))]
            if rnd.random() < 0.6:
                w.pop(rnd.randrange(len(w)))
            rnd.shuffle(w)
            lines.append(rnd.choice([" ", "-", ", "]).join(w))
        rows.append((10_000 + k, rnd.choice(["\n", "\n\n", "\r\n"]).join(lines)))
    rows += [(20_000, None), (20_001, ""), (20_002, "MIT License mit license MIT-License"), (None, "apache\nlicense"), (20_003, "x " * 100_000 + "general public license"), (20_003, "x")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, labels string").repartition(3)
    got = sorted((tuple(r) for r in scan(spark, df).collect()), key=str)
    assert got == sorted(((i, *brute_scan(t)) for i, t in rows), key=str)
    assert scan(spark, df.limit(0)).count() == 0
    assert scan(spark, df, templates=()).where("labels <> base_labels").count() == 0


def test_filters_keep_every_pair():
    known = licenses._Templates(TEMPLATES, licenses.CONTAINMENT, {})
    for s, k in zip(known.sets, known.need):
        assert 0 < k <= len(s) and len(s) - k + 1 >= 1


def test_wrapped_statements_are_found(spark):
    rows, want = [], []
    for k, (label, t) in enumerate(TEMPLATES):
        w = t.split()
        for lines in (2, 3, 4):
            cut = [round(i * len(w) / lines) for i in range(lines + 1)]
            parts = [" ".join(w[a:b]) for a, b in zip(cut, cut[1:])]
            rows.append((10 * k + lines, "Some file\n\n * " + "\n * ".join(parts) + ".\n\nint main"))
            want.append((label, 1))
    whole = TEMPLATES[2][1]
    rows += [(1000, f"{whole}\n{whole}"), (1001, f"of the person\n{whole}\nto any person"), (1002, "redistribution and use\n" + "x " * 40 + "\n" + TEMPLATES[9][1][23:])]
    rows += [(1003, "licensed under\ncc by nc 4 0"), (1004, TEMPLATES[12][1].replace(" ", "\n"))]
    want += [("mit", 2), ("mit", 1), ("", 0), ("cc-by-nc", 1), ("cc-by", 1)]
    got = {r.doc_id: r for r in scan(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, text), (label, n) in zip(rows, want, strict=True):
        r = got[i]
        assert set(r.labels.split(",")) == {label, *r.base_labels.split(",")} - ({""} if label else set()), text
        assert (r.n_blocks, r.score) == (n, min(n, 1)), text


# -- decontamination --------------------------------------------------------------------------------


def brute_align(item, window):
    best, h = 0, [[0] * (len(window) + 1) for _ in range(len(item) + 1)]
    for i, x in enumerate(item, 1):
        for j, y in enumerate(window, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_brute_force():
    rnd = random.Random(4)
    for _ in range(200):
        a, b = ([rnd.randrange(6) for _ in range(rnd.randint(1, 14))] for _ in range(2))
        score, first, end = align(np.array(a, np.uint64), np.array(b, np.uint64))
        assert score == brute_align(a, b)
        assert brute_align(a, b[first:end]) == score and 0 <= first <= end <= len(b)


@pytest.fixture(scope="module")
def planted(spark):
    rnd = random.Random(9)
    common = [f"c{k}" for k in range(30)]
    say = lambda n: [rnd.choice(common) if rnd.random() < 0.6 else f"r{rnd.randrange(4000)}" for _ in range(n)]
    items = {k: say(rnd.randint(20, 50)) for k in range(30)}
    docs, want = [], set()
    for k in range(200):
        body = say(rnd.randint(0, 300))
        if k % 4 == 0:
            item = k // 4 % 30
            own = list(items[item])
            for _ in range(len(own) // 7):  # edits: replaced, dropped and added words
                p = rnd.randrange(len(own))
                how = rnd.random()
                own[p : p + 1] = [f"e{rnd.randrange(99)}"] if how < 0.6 else [] if how < 0.8 else [own[p], "added"]
            at = rnd.randrange(len(body) + 1)
            body[at:at] = own
            want.add((k, item))
        docs.append((k, " ".join(body).capitalize() + "."))
    return docs, [(k, ", ".join(w)) for k, w in items.items()], want


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_edited_copies_are_found_and_others_left_alone(spark, planted, block):
    docs, items, want = planted
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int").repartition(3)
    b = spark.createDataFrame([*items, (77, None), (None, "a b c d e f"), (78, "too short")], "item_id long, text string")
    got = leaks(spark, d, b, block_words=block).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    for r in got:
        w = words(docs[r.doc_id][1])[r.first_word : r.end_word]
        assert abs(r.score - brute_align(words(items[r.item_id][1]), w) / 2 / len(words(items[r.item_id][1]))) < 1e-9


def test_decontamination_edges(spark):
    schema, items = "doc_id long, text string", "item_id long, text string"
    b = spark.createDataFrame([(1, "one two three four five six")], items)
    d = spark.createDataFrame([(1, None), (2, ""), (3, "One, two three FOUR five six!"), (3, "One, two three FOUR five six!"), (None, "one two three four five six"), (4, "z " * 200_000 + "one two three four five six")], schema)
    assert sorted((str(r.doc_id), r.item_id, r.score) for r in leaks(spark, d, b).collect()) == [("3", 1, 1.0), ("3", 1, 1.0), ("4", 1, 1.0), ("None", 1, 1.0)]
    assert leaks(spark, d, b.limit(0)).count() == 0 and leaks(spark, d.limit(0), b).count() == 0


def test_every_copy_that_reaches_the_threshold_is_found(spark):
    rnd = random.Random(12)
    items = {r.item_id: words(r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()}
    items |= {900 + n: [f"s{n}x{k}" for k in range(n)] for n in range(5, 15)}
    docs = []
    for item, own in items.items():
        for share in (0.15, 0.2, 0.25):
            copy = list(own)
            for p in rnd.sample(range(len(own)), round(share * len(own))):
                copy[p] = f"e{rnd.randrange(99)}"
            docs.append((item, copy))
        docs.append((item, [x for k, w in enumerate(own) for x in ([w, "added"] if k % 2 else [w])]))  # no three words together
        docs.append((item, [w for k, w in enumerate(own) if k % 5 != 2]))
    docs.append((905, " and ".join(items[905]).split()))
    docs = [(k, item, ["f1", "f2", *copy, "f3"]) for k, (item, copy) in enumerate(docs)]
    want = {(k, item) for k, item, copy in docs if brute_align(items[item], copy) >= 1.2 * len(items[item])}
    assert 150 < len(want) < len(docs)
    d = spark.createDataFrame([(k, " ".join(copy)) for k, _, copy in docs], "doc_id long, text string").repartition(3)
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    mine = {k: item for k, item, _ in docs}
    assert {(r.doc_id, r.item_id) for r in leaks(spark, d, b).collect() if mine[r.doc_id] == r.item_id} == want


def found(spark, docs, items, **how):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in leaks(spark, d, b, **how).collect()}


def test_pairs_and_scores_equal_brute_force(spark):
    rnd = random.Random(31)
    say = lambda n: [rnd.choice(("of the a in to and is it".split() * 3) + [f"w{k}" for k in range(25)]) for _ in range(n)]
    items = [say(rnd.randint(1, 16)) for _ in range(40)]
    docs = []
    for _ in range(150):
        own = say(rnd.randint(0, 40))
        for _ in range(rnd.randint(0, 3)):
            copy = [w for w in rnd.choice(items) if rnd.random() < 0.9]
            for _ in range(rnd.randint(0, 4)):
                copy.insert(rnd.randint(0, len(copy)), rnd.choice(["x", "of", "w3"]))
            at = rnd.randint(0, len(own))
            own[at:at] = copy
        docs.append(own)
    want = {}
    for i, d in enumerate(docs):
        for j, item in enumerate(items):
            n = len(item)
            if n < 5:
                at = [k for k in range(len(d)) if d[k : k + n] == item]
                if at:
                    want[i, j] = (1.0, at[0], at[0] + n)
            elif brute_align(item, d) >= 1.2 * n:
                want[i, j] = (brute_align(item, d) / (2 * n), None, None)
    got = found(spark, [" ".join(d) for d in docs], [" ".join(x) for x in items])
    assert got.keys() == want.keys() and len(want) > 300
    for (i, j), (score, first, end) in want.items():
        r = got[i, j]
        assert abs(r.score - score) < 1e-9
        if first is None:
            assert brute_align(items[j], docs[i][r.first_word : r.end_word]) == round(2 * len(items[j]) * score)
        else:
            assert (r.first_word, r.end_word) == (first, end)


def test_halves_gaps_and_short_items(spark):
    item = [f"i{k}" for k in range(50)]
    half = [f"e{k}" if k % 2 else w for k, w in enumerate(item[:25])] + item[25:]
    gap = item[:20] + ["g"] * 30 + item[20:]
    wide = item[:25] + ["g"] * 38 + item[25:]
    docs = [["a"] * 30 + x + ["z"] * 30 for x in (half, gap, wide)]
    docs += [["four", "score", "and", "seven", "years"], ["four", "score", "and", "some", "years"], ["seven"]]
    items = [item, ["four", "score", "and", "seven"], ["seven"], []]
    got = found(spark, [" ".join(d) for d in docs], [" ".join(x) for x in items])
    assert got.keys() == {(0, 0), (1, 0), (2, 0), (3, 1), (3, 2), (5, 2)}
    for k in range(3):
        assert abs(got[k, 0].score - brute_align(item, docs[k]) / 100) < 1e-9
    assert (got[1, 0].first_word, got[1, 0].end_word) == (30, 110) and (got[3, 1].first_word, got[3, 1].end_word) == (0, 4)
    assert found(spark, [" ".join(d) for d in docs], [" ".join(x) for x in items], least_words=3).keys() == {(0, 0), (1, 0), (2, 0), (3, 1)}


def test_seeds_left_out_are_the_most_frequent_and_too_few_to_matter():
    from factloom.llm.decontam import _Items

    own = _Items([(1, "a b c d e f g h i j k l m n o p q r s t"), (2, "a b a b a b a b c d e f g h i j k l m n")], 0.6, 1)
    (table,) = own.tables
    table.leave_out(np.arange(len(table.seed)), own.need)
    for item in (0, 1):
        mine = table.item == item
        seen = np.repeat(np.arange(len(table.seed)), table.count)
        assert table.places[mine & ~table.rare].sum() < own.need[item]
        assert seen[mine & ~table.rare].min(initial=10**9) > seen[mine & table.rare].max()


def test_empty_and_null_benchmark(spark):
    d = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")
    for rows in ([], [(1, None)], [(None, "one two three four five six")], [(1, ""), (2, " .,; ")]):
        b = spark.createDataFrame(rows, "item_id long, text string")
        assert leaks(spark, d, b).count() == 0 and without_leaks(spark, d, b).count() == 1
