"""The Jaccard join against brute force."""

import random
import re
from fractions import Fraction

import numpy as np
import pytest

from factloom.llm.common import NOT_SPACE, Words, texts_of
from factloom.llm.jaccard_join import NEAR, bounds_from, candidate_links, exact_links, jaccard_components, leaf_keys, shingle_sets, sketch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=3):
    w = re.findall(r"[^ \t-\r]+", (text or "").translate(LOWER))
    return set(zip(*(w[k:] for k in range(n)))) if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n=3, percent=90):
    sets = [(i, shingles(t, n)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1 :]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return sorted((i if i is not None else -1, len(shingles(t, n)), root(i) if i is not None else -1) for i, t in rows)


def corpus(seed, groups=12):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["the", "of"] * 40
    rows = []
    for _ in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 3, 5, 9, 12, 25, 60, 150, 400]))]
        for _ in range(rnd.choice([1, 2, 8, 30])):
            x = list(base)
            for _ in range(rnd.randint(0, max(1, len(x) // 35))):
                p = rnd.randrange(len(x))
                x[p] = rnd.choice(vocabulary) if rnd.random() < 0.5 else x[p].upper()
            if rnd.random() < 0.2:
                x = x[: max(1, len(x) - len(x) // 25)]
            rows.append((len(rows) * 7 % 1009, " ".join(x)))
    return rows


EDGES = [(2001, None), (2002, ""), (2003, " \n"), (2004, "a"), (2005, "A"), (None, "some text of nobody"), (None, None), (2006, "a b"), (2007, "one two three"), (2007, "one two three")]


@pytest.mark.parametrize(("seed", "cluster"), [(1, 4_000), (2, 5)])
def test_components_equal_brute_force(spark, seed, cluster):
    rows = corpus(seed) + EDGES
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, id string").repartition(5)
    got = jaccard_components(spark, df, cluster=cluster).collect()
    norm = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in got)
    assert norm == brute(rows)


def test_one_id_with_several_texts_ties_them(spark):
    long = " ".join(f"x{k}" for k in range(50))
    rows = [(1, long), (2, long), (2, "quite another text here"), (3, "quite another text here")]
    got = {(r.doc_id, r.component_id) for r in jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)}


def test_empty_table(spark):
    assert jaccard_components(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(tuple(r) for r in jaccard_components(spark, docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def sets_of(texts):
    import pyarrow as pa

    raw, offsets = texts_of(pa.array(texts, pa.string()))
    h, first = shingle_sets(raw, offsets, 3)
    return [h[a:b] for a, b in zip(first[:-1], first[1:])], h, first


def test_similar_sets_share_a_kept_leaf():
    rnd = np.random.default_rng(5)
    for n in (9, 10, 19, 20, 21, 40, 100, 1_000):
        for _ in range(40):
            a = rnd.integers(0, 2**63, n).astype(np.uint64)
            most = max(0, int(n * 0.1))  # shingles taken away and added, within similarity 0.9
            while True:
                out, new = int(rnd.integers(0, most + 1)), int(rnd.integers(0, most + 1))
                if 10 * (n - out) >= 9 * (n + new):
                    break
            b = np.concatenate([rnd.permutation(a)[out:], rnd.integers(0, 2**63, new).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            keys, first = leaf_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 8, Fraction(1, 20))
            assert set(keys[: first[1]].tolist()) & set(keys[first[1] :].tolist())


def test_links_in_a_region_and_a_cluster():
    texts = [t for _, t in corpus(7, 6) if len(t.split()) >= 3]
    sets, _, _ = sets_of(texts)
    n, r = len(sets), Fraction(1, 10)

    def classes(links):
        up = list(range(n))

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in links:
            up[root(a)] = root(b)
        return [root(x) for x in range(n)]

    truth = [(a, b) for a in range(n) for b in range(a) if 10 * len(np.intersect1d(sets[a], sets[b])) >= 9 * len(np.union1d(sets[a], sets[b]))]
    want = classes(truth)
    exact = exact_links(sets, r, pivots=3)
    got = classes(exact)
    assert all((got[a] == got[b]) == (want[a] == want[b]) for a in range(n) for b in range(a))
    assert all((max(a, b), min(a, b)) in set(truth) for a, b in exact) and len(exact) < n
    wide = classes(candidate_links(np.arange(n), np.array([len(s) for s in sets]), [sketch(s) for s in sets], r))
    assert all(wide[a] == wide[b] for a, b in truth)


def test_word_bytes_follow_the_contract():
    import pyarrow as pa

    texts = ["", "Aé B\tc\n", "x", "\x0b\x0c y\x1cz", "ÀB", None, "end"]
    raw, offsets = texts_of(pa.array(texts, pa.string()))
    w = Words(raw, offsets, NOT_SPACE)
    got = [[bytes(raw[a:b]).decode() for a, b in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.first[:-1], w.first[1:])]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def components(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard_components(spark, df, **how).collect()
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in got)


def shared_footer(seed, n):
    """Short documents that all end alike, some near copies among them, and one large ball of copies of copies."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(5_000)}"
    footer = " ".join(f"foot{k}" for k in range(30))
    rows, bodies = [], []
    for i in range(n):
        if bodies and rnd.random() < 0.3:
            body = list(rnd.choice(bodies))
            body[rnd.randrange(len(body))] = word()
        else:
            body = [word() for _ in range(rnd.choice([3, 10, 40, 60]))]
        bodies.append(body)
        rows.append((i, " ".join(body) + " " + footer))
    ball = [word() for _ in range(150)]
    for i in range(n // 2):
        x = list(ball)
        for _ in range(rnd.randint(0, 5)):
            x[rnd.randrange(len(x))] = word()
        rows.append((10_000 + i, " ".join(x)))
    return rows


@pytest.mark.parametrize(("cluster", "words", "percent"), [(8, 3, 90), (8, 5, 80), (128, 5, 80)])
def test_a_footer_that_all_share(spark, monkeypatch, cluster, words, percent):
    from factloom.llm import jaccard_join

    rows = shared_footer(4, 400)
    monkeypatch.setattr(jaccard_join, "PROJECTIONS", 1)  # so that the last way out is taken, too
    assert components(spark, rows, cluster=cluster, words=words, similarity=Fraction(percent, 100)) == brute(rows, words, percent)


def test_five_words_and_four_fifths(spark):
    rows = corpus(3) + [e for e in EDGES if e[0] != 2007]
    assert components(spark, rows, words=5, similarity=Fraction(4, 5)) == brute(rows, 5, 80)


def test_long_runs_of_one_key_pass_through(spark, monkeypatch):
    from factloom.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "LONG_RUN", 20)
    monkeypatch.setattr(jaccard_join, "CLUSTER_BYTES", 4_000)
    rows = shared_footer(5, 150)
    assert components(spark, rows, cluster=10) == brute(rows)


@pytest.mark.parametrize("similarity", [Fraction(9, 10), Fraction(4, 5)])
def test_windows_hold_whatever_is_near_a_member_that_left(similarity):
    rng, r = np.random.default_rng(3), 1 - similarity
    for n in (3, 20, 63, 64, 120, 127, 128, 129, 300, 1_000, 2_100):
        for _ in range(20):
            p = rng.integers(0, 2**64, n, np.uint64, endpoint=False)
            x = np.append(rng.permutation(p)[int(rng.integers(0, n // 2 + 1)) :], rng.integers(0, 2**64, int(rng.integers(0, n // 2 + 1)), np.uint64))
            out = int(rng.integers(0, int(len(x) * r) + 1))
            y = rng.permutation(x)[out:]
            new = max(0, int(len(y) / similarity - len(x)))
            y = np.append(y, rng.integers(0, 2**64, int(rng.integers(0, new + 1)), np.uint64))
            p, x, y = map(np.unique, (p, x, y))
            if len(np.intersect1d(x, y)) < similarity * len(np.union1d(x, y)):
                continue
            d, whole = bounds_from(np.array([len(x), len(y)]), [sketch(x), sketch(y)], [sketch(p)], r)
            for a, b in ((0, 1), (1, 0)):
                if whole[a, 0] and d[a, 0] <= NEAR:
                    assert d[b, 0] <= NEAR / float(1 - r) + 1 + 1e-9


def test_very_long_texts(spark):
    rnd = random.Random(8)
    long = [f"w{rnd.randrange(30_000)}" for _ in range(120_000)]
    near, far = list(long), list(long)
    for k in range(0, len(long), 120):
        near[k] = "changed"
    for k in range(0, len(long), 20):
        far[k] = "changed"
    rows = [(k, " ".join(x)) for k, x in enumerate((long, near, far, ["the"] * 200_000, ["the"] * 3, ["the"] * 2))]
    assert components(spark, rows) == brute(rows)


def test_a_common_line_brings_no_sets_together(spark, tmp_path):
    from factloom.llm.common import Scratch
    from factloom.llm.jaccard_join import _close_sets, _stage

    rnd = random.Random(6)
    line = " one line that stands in every text"
    texts = [" ".join(f"w{rnd.randrange(9_000)}" for _ in range(150)) + line for _ in range(300)]
    rows = list(enumerate([*texts, texts[0] + " more"]))
    r, share = Fraction(1, 10), Fraction(1, 10)
    staged = _stage(spark.createDataFrame(rows, "doc_id long, text string"), 3, 8, share / 4)
    links = _close_sets(staged, share, r, Scratch(spark, "test"))
    assert links.count() == 1


def test_pairs_that_share_leaves_but_are_far_go_by_their_sketches(spark):
    from factloom.llm.common import Scratch
    from factloom.llm.jaccard_join import _close_sets, _stage

    rnd = random.Random(9)
    rows, near = [], set()
    for k in range(60):
        base = [f"w{rnd.randrange(9_000)}" for _ in range(400)]
        x = [f"n{rnd.randrange(9_000)}" if j % (12 if k % 2 else 150) == 5 else w for j, w in enumerate(base)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(x))]
        if k % 2 == 0:
            near.add((2 * k, 2 * k + 1))
    r, share = Fraction(1, 10), Fraction(1, 10)
    staged = _stage(spark.createDataFrame(rows, "doc_id long, text string"), 3, 8, share / 4)
    node = {r.node: r.doc_id for r in staged.select("node", "doc_id").collect()}
    got = {tuple(sorted((node[x.a], node[x.b]))) for x in _close_sets(staged, share, r, Scratch(spark, "test")).collect()}
    assert got == near


def test_sketches_of_any_widths_are_no_further_apart_than_sets():
    from factloom.llm.jaccard_join import sketch_distances

    rng = np.random.default_rng(11)
    some, others, most = [], [], []
    for n in (1, 5, 63, 64, 127, 128, 700, 2_047, 2_048, 40_000):
        for out in (0, 1, n // 10, n // 2, n):
            x = np.unique(rng.integers(0, 2**64, n, np.uint64, endpoint=False))
            y = np.unique(np.append(rng.permutation(x)[out:], rng.integers(0, 2**64, out // 2 + 1, np.uint64)))
            some.append(sketch(x)), others.append(sketch(y)), most.append(len(np.setxor1d(x, y)))
    d = sketch_distances(some, others)
    assert (d <= most).all() and d.max() > 0
    assert (sketch_distances(some, some) == 0).all() and len(sketch_distances([], [])) == 0
