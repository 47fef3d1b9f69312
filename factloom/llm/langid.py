"""Language identification in two steps: the family first, then one-versus-one linear support
vector machines between the languages of that family.

Features are counts of letter 1-, 2- and 3-grams of the whole text (UTF-8 bytes, A-Z lower-cased,
everything that is no letter is one separator), hashed into ``FEATURES`` cells, square-rooted and scaled
to unit length. The machines are fitted on the driver on a bounded sample (``SAMPLE`` documents in all,
the same share for each language, chosen by a hash of doc_id and text); prediction is one pass without a
shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed_sample, small_batches, texts_of

#: Documents that the classifier is fitted on, at most so many whatever the corpus (but eight of each language).
SAMPLE = 3_000
BITS = 12
FEATURES = 1 << BITS

#: Language codes of each family; a code not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky",
    "celtic": "ga cy br gd",
    "indo-aryan": "hi bn ur mr gu pa ne",
    "semitic": "ar he mt",
    "sinitic": "zh yue wuu",
    "malayic": "id ms",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_CODE = np.zeros(256, np.uint32)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_CODE[128:] = np.arange(128, 256)
_PIECE = 1 << 20


def features(raw: np.ndarray) -> np.ndarray:
    """The unit vector of one text's bytes (zero for a text without letters)."""
    out = np.zeros(FEATURES, np.float64)
    for a in range(0, max(1, len(raw)), _PIECE):  # pieces overlap by two bytes
        c = _CODE[raw[a : a + _PIECE + 2]]
        one = c * np.uint32(0x9E3779B1)
        grams = [one[:_PIECE], (one[:-1] ^ (c[1:] * np.uint32(0x85EBCA77)))[:_PIECE], (one[:-2] ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D)))[:_PIECE]]
        for n, g in enumerate(grams):
            letters = c[: len(g)] > 0
            if n:
                letters = letters | (c[n : n + len(g)] > 0)
            h = g[letters] + np.uint32(n)
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            out += np.bincount(h >> np.uint32(32 - BITS), minlength=FEATURES)
    out = np.sqrt(out)
    norm = np.linalg.norm(out)
    return (out / norm if norm else out).astype(np.float32)


_ASCII_LETTER = re.compile(r"[A-Za-z]").search


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER(text)) or any(map(str.isalpha, text)))


def linear_svm(x: np.ndarray, y: np.ndarray, *, cost: float = 20.0, rounds: int = 60) -> np.ndarray:
    """Weights of squared-hinge linear machines on unit rows whose last column is 1, for the bias.

    ``y`` holds a column of -1 and 1 for each machine. Accelerated gradient steps on the primal problem.
    """
    w = np.zeros((x.shape[1], y.shape[1]), x.dtype)
    v, scale = w.copy(), cost / max(1, len(x))
    step = 1.0 / (1.0 + 2 * scale * len(x) * 2.0)  # rows have squared length 2
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (v * x.dtype.type(1e-3) - 2 * scale * (x.T @ (y * slack)))
        v = new + (new - w) * x.dtype.type(k / (k + 3))
        w = new
    return w


def fit(x: np.ndarray, langs: list[str]) -> dict:
    """The model of a sample: families, their machines, and the pairs' machines. The last column of ``x`` is 1, for the bias."""
    names = sorted(set(langs))
    family = {n: _FAMILY.get(n.lower().split("-")[0].split("_")[0], n) for n in names}
    families = sorted(set(family.values()))
    label = np.array(langs)
    of = np.array([family[n] for n in langs])
    model: dict = {"families": families, "family": None, "members": {f: [n for n in names if family[n] == f] for f in families}, "pairs": {}}
    if len(families) > 1:
        model["family"] = linear_svm(x, np.where(of[:, None] == np.array(families)[None], 1, -1).astype(x.dtype))
    for f in families:
        for a, b in combinations(model["members"][f], 2):
            both = (label == a) | (label == b)
            model["pairs"][a, b] = linear_svm(x[both], np.where(label[both] == a, 1, -1).astype(x.dtype)[:, None])[:, 0]
    return model


def predict(model: dict, x: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(languages, scores): score is the family's share times the share of won and weighted duels."""
    n = len(x)
    x = np.hstack([x, np.ones((n, 1), x.dtype)]).astype(np.float64)
    if model["family"] is None:
        best, share = np.zeros(n, int), np.ones(n)
    else:
        e = np.exp(np.clip(3.0 * (x @ model["family"]), -40, 40))
        best, share = e.argmax(axis=1), e.max(axis=1) / e.sum(axis=1)
    out = np.empty(n, object)
    for k, f in enumerate(model["families"]):
        rows, own = np.flatnonzero(best == k), model["members"][f]
        won = np.ones((len(rows), len(own)))
        for i, j in combinations(range(len(own)), 2):
            p = 1 / (1 + np.exp(-np.clip(6.0 * (x[rows] @ model["pairs"][own[i], own[j]]), -40, 40)))
            won[:, i] *= p
            won[:, j] *= 1 - p
        pick = won.argmax(axis=1)
        out[rows] = np.array(own, object)[pick]
        share[rows] *= won.max(axis=1) / np.maximum(won.sum(axis=1), 1e-300)
    return out.tolist(), np.clip(share, 0.0, 1.0)


def _rows(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    raw, offsets = texts_of(batch.column(column))
    for k in range(batch.num_rows):
        yield k, raw[offsets[k] : offsets[k + 1]]


def packed(x: np.ndarray) -> bytes:
    """A vector in half precision, compressed: most cells are empty and the others have few values. Empty if all are."""
    return zlib.compress(x.astype(np.float16).tobytes(), 1) if x.any() else b""


def learn(docs: DataFrame, *, folds: int = 5, sample: int = SAMPLE) -> dict | None:
    """Fit on text and lang of the documents outside fold 0; None where no language is to be learned."""
    small_batches(docs.sparkSession)
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 0)
    # different texts, so one that repeats without end does not hide the others
    texts = F.approx_count_distinct(F.xxhash64("doc_id", "text"))
    counts = known.groupBy("lang").agg(texts.alias("n")).orderBy("lang").collect()
    if not counts:
        return None
    quota = max(8, sample // len(counts))
    sizes = F.create_map(*[x for r in counts for x in (F.lit(r.lang), F.lit(r.n))])
    some = hashed_sample(known.select("doc_id", "lang", "text"), ["doc_id", "text"], quota, total=sizes[F.col("lang")], label="language sample", within=["lang"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [packed(features(raw)) for _, raw in _rows(batch, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], ["doc_id", "lang", "x"])

    got = some.select("doc_id", "lang", "text").mapInArrow(vectors, "doc_id long, lang string, x binary").toArrow()
    rows = sorted((i, lang, x) for i, lang, x in zip(*(c.to_pylist() for c in got.columns), strict=True) if x)
    if not rows:
        return None
    x = np.ones((len(rows), FEATURES + 1), np.float32)
    for k, r in enumerate(rows):  # one by one: the driver holds the sample in full once
        x[k, :FEATURES] = np.frombuffer(zlib.decompress(r[2]), np.float16)
    return fit(x, [r[1] for r in rows])


def language_of(model: dict | None) -> Callable[[Column], Column]:
    """A column function: struct of lang_pred and score of a text. Other columns of a row stay in the JVM."""

    def label(texts: pa.Array) -> pa.Array:
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        if model is not None:
            raw, offsets = texts_of(texts)
            known = np.flatnonzero([has_letter(t) for t in texts.to_pylist()])
            for a in range(0, len(known), 512):
                at = known[a : a + 512]
                found, scores[at] = predict(model, np.array([features(raw[offsets[k] : offsets[k + 1]]) for k in at]))
                for k, f in zip(at.tolist(), found, strict=True):
                    langs[k] = f
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores)], ["lang_pred", "score"])

    return F.arrow_udf(label, "struct<lang_pred: string, score: double>")


def identify(spark: SparkSession, docs: DataFrame, *, folds: int = 5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of every row of ``docs(doc_id, text, lang)``.

    Learned from rows whose crc32(doc_id as text) mod ``folds`` is not 0 (``held_out`` is false there);
    prediction sees the text alone. Null text, or text without a letter: ``und`` with score 0; so is every
    row if nothing could be learned. Null doc_id: predicted, not learned from, not held out. Repeated
    rows: each its own row. Extra columns are not read.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    found = docs.select("doc_id", held.alias("held_out"), language_of(learn(docs, folds=folds, sample=sample))(F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def in_some_language(spark: SparkSession, docs: DataFrame, *, least_score: float, folds: int = 5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are in a known language with at least ``least_score``."""
    p = language_of(learn(docs, folds=folds))(F.col("text"))
    return docs.where((p["lang_pred"] != "und") & (p["score"] >= least_score))
