"""The pipeline's stages against what their operators decide, and each other."""

from collections import Counter
from fractions import Fraction

import corpus_pipeline
import numpy as np
import pytest
from test_jaccard import brute
from test_text_ops import words
from test_tokens import check_packed, one_by_one, reference

from factloom.llm.decontam import align, leaks
from factloom.llm.jaccard_join import jaccard_components, without_copies
from factloom.llm.langid import identify

COLUMNS = list(corpus_pipeline.COLUMNS)


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect()), key=str)


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    odd = [(None, "the house of nobody", "en", "s", 1), (900, None, "en", "s", 0), (901, "12345 ...", None, None, None), (902, "", "en", "s", 0)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(docs.limit(5))
    for name, f in corpus_pipeline.STAGES:
        before = docs
        path = str(tmp_path_factory.mktemp("stage") / name)
        f(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, before, docs))
    return out


def test_stages_return_documents(stages):
    assert [n for n, _, _ in stages] == ["language_id", "near_duplicates", "decontamination", "packing"]
    assert all(after.columns == COLUMNS for _, _, after in stages[:-1])


def test_language_stage(spark, stages):
    _, before, after = stages[0]
    gone = {r.doc_id for r in identify(spark, before).where(f"lang_pred = 'und' OR score < {corpus_pipeline.LEAST_SCORE}").collect()}
    assert gone == {900, 901, 902}
    assert rows(after) == sorted((x for x in rows(before) if x[0] not in gone), key=str)


def test_near_duplicate_stage(spark, stages):
    _, before, after = stages[1]
    found = jaccard_components(spark, before, words=5, similarity=Fraction(4, 5))
    first = {r.doc_id for r in found.where("doc_id = component_id").collect()}
    kept = rows(after)
    assert [x[0] for x in kept if x[0] is not None] == sorted(first, key=str) and sum(x[0] is None for x in kept) == 1
    assert len(first) < before.select("doc_id").distinct().count()


def test_decontamination_stage(spark, stages, sf_dir):
    _, before, after = stages[2]
    bad = {r.doc_id for r in leaks(spark, before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert bad and rows(after) == sorted((x for x in rows(before) if x[0] not in bad), key=str)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(t in x[1] for x in rows(after) for t in texts)


def test_packing_stage(stages):
    _, before, after = stages[3]
    check_packed(after.collect(), [(r.doc_id, r.text, None) for r in before.collect()])


def test_run_equals_the_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, sf_dir)
    got = corpus_pipeline.run(spark, sf_dir)
    pieces = sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in got.collect())
    assert len({r[0] for r in pieces}) == docs.count() and corpus_pipeline.ORACLE_SQL is None


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs, sf_dir).count() == 0


def test_run_equals_brute_force(spark, sf_dir):
    """Every stage over all rows in plain form: shingle sets of all pairs, alignments of all pairs, pieces one by one."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = {r.doc_id for r in identify(spark, table).collect() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE}
    texts = {r.doc_id: r.text for r in table.collect() if r.doc_id in known}
    texts = {i: texts[i] for i, _, first in brute(list(texts.items()), 5, 80) if i == first}
    number: dict[str, int] = {}
    coded = lambda t: np.array([number.setdefault(w, len(number)) for w in words(t)], np.uint64)
    items = [coded(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {i: t for i, t in texts.items() if not any(align(item, coded(t))[0] >= 1.2 * len(item) for item in items)}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    check_packed(got, [(i, t, None) for i, t in clean.items()])
    sizes = Counter(min(1024, n - a) for t in clean.values() for n in [len(reference(t)) + 1] for a in range(0, n, 1024))
    total = Counter()
    for r in got:
        total[r.sequence_id] += r.length
    assert sorted(total.values()) == one_by_one(sizes, 1024)


def test_texts_that_share_an_id_are_judged_each(spark):
    text = lambda tag, n=30: " ".join(f"{tag}{k}" for k in range(n))
    rows = [(1, text("a")), (2, text("a") + " more"), (2, text("b")), (2, text("b")), (3, text("b")), (4, text("c")), (4, text("d")), (4, None), (4, ""), (None, text("a")), (None, text("a"))]
    df = spark.createDataFrame([(i, t, f"x{k}") for k, (i, t) in enumerate(rows)], "doc_id long, text string, node string")
    got = sorted(((r.doc_id, r.text) for r in without_copies(spark, df.drop("node")).collect()), key=str)
    want = [(None, text("a"))] * 2 + [(1, text("a")), (2, text("b")), (4, text("c")), (4, text("d"))]
    assert [x for x in got if x[1]] == sorted(want, key=str) and sum(x == (4, "") or x == (4, None) for x in got) == 1
    assert without_copies(spark, df.drop("node").limit(0)).count() == 0


def test_benchmark_without_items(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(5)
    for k, rows in enumerate(([], [(None, None), (1, None), (2, ""), (3, "the")])):
        spark.createDataFrame(rows, "item_id long, text string").write.parquet(str(tmp_path / str(k) / "benchmark.parquet"))
        assert corpus_pipeline.decontamination(spark, docs, str(tmp_path / str(k))).count() == 5
