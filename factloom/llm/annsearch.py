"""Nearest neighbours by additive quantisation: a vector's direction is the sum of one codeword from
each of several full-dimensional codebooks.

Codebooks are fitted one after another to the residuals of a bounded sample. Every vector is encoded by a
beam search over them, and its norm is stored, divided by that of its code. A query scores codes by
lookup tables (one inner product for each codeword); the best of each block are scored
exactly, in double precision, on the original vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, hashed_sample, small_batches

#: Vectors that the codebooks are fitted on, at most so many whatever the table.
SAMPLE = 8_192
CODEBOOKS, WORDS, BEAM = 24, 256, 4
#: Codes that one lookup pass scores, queries that the driver holds at a time.
BLOCK, QUERY_BLOCK = 8_192, 16_384
#: Candidates for exact scoring that a query gets in all: this many, and this share of the vectors.
RERANK, RERANK_SHARE = 480, 0.01


def fit_codebooks(x: np.ndarray, *, codebooks: int = CODEBOOKS, words: int = WORDS, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Codebooks (codebooks, words, dimension): k-means of what the earlier ones leave over."""
    rng = np.random.default_rng(seed)
    rest, out = x.astype(np.float32).copy(), []
    words = min(words, len(x))
    for _ in range(codebooks):
        c = rest[rng.choice(len(rest), words, replace=False)].copy()
        for _ in range(rounds):
            near = (rest @ c.T - (c**2).sum(1) / 2).argmax(1)
            count = np.bincount(near, minlength=words)
            order = np.argsort(near, kind="stable")
            some = np.flatnonzero(count)
            c[some] = np.add.reduceat(rest[order], np.append(0, np.cumsum(count[some]))[:-1], axis=0) / count[some, None]
        near = (rest @ c.T - (c**2).sum(1) / 2).argmax(1)
        rest -= c[near]
        out.append(c)
    return np.array(out)


def encode(x: np.ndarray, books: np.ndarray, *, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(codes, decoded) of the best sums that a beam search finds."""
    n, m, k = len(x), len(books), books.shape[1]
    rest = x[:, None, :].astype(np.float32)  # (n, beams, dimension)
    codes = np.zeros((n, 1, 0), np.uint8)
    rows = np.arange(n)[:, None]
    for c in books:
        norm = (c**2).sum(1)
        gain = (rest**2).sum(2)[:, :, None] - 2 * (rest.reshape(-1, rest.shape[2]) @ c.T).reshape(n, -1, k) + norm
        flat = gain.reshape(n, -1)
        b = min(beam, flat.shape[1])
        best = np.argpartition(flat, b - 1, axis=1)[:, :b]
        parent, word = best // k, best % k
        rest = rest[rows, parent] - c[word]
        codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.uint8)], axis=2)
    pick = (rest**2).sum(2).argmin(1)
    return codes[np.arange(n), pick], x - rest[np.arange(n), pick]


def _clean(vectors: DataFrame, dimension: int, kind: str) -> DataFrame:
    """(vec_id, mark, vector) of the usable rows of one length, components as ``kind`` has them; equal vectors have equal marks."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, raws = [], [], []
            col = batch.column(1)
            flat = col.flatten()
            values = np.asarray(flat.to_numpy(zero_copy_only=False), kind)
            x = values.reshape(-1, dimension) + values.dtype.type(0)  # -0 becomes 0
            usable = np.isfinite(x).all(axis=1) & x.any(axis=1)
            for i, k in enumerate(batch.column(0).to_pylist()):
                if usable[i]:
                    raw = x[i].tobytes()
                    ids.append(k), raws.append(raw), marks.append(hashlib.blake2b(raw, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.binary()), pa.array(raws, pa.binary())], ["vec_id", "mark", "vector"])

    v = F.col("embedding")
    usable = vectors.where(F.col("vec_id").isNotNull() & (F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)))
    return usable.select("vec_id", "embedding").mapInArrow(clean, "vec_id long, mark binary, vector binary")


def _directions(raw: list[bytes], dimension: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, norms)."""
    wide = np.frombuffer(b"".join(raw), kind).reshape(-1, dimension).astype(np.float64)
    # by the largest component first, so that squares neither overflow nor vanish
    most = np.abs(wide).max(axis=1)
    norm = most * np.sqrt(((wide / most[:, None]) ** 2).sum(1))
    return (wide / norm[:, None]).astype(np.float32), norm


def build_index(vectors: DataFrame, scratch: Scratch, *, dimension: int, kind: str, top: int, sample: int = SAMPLE, codebooks: int = CODEBOOKS) -> tuple[DataFrame, np.ndarray]:
    """The written index (members, vector, codes, norm), one row per distinct vector, and its codebooks.

    Equal vectors share one row with their ``top + 1`` smallest ids: no more can be among the nearest
    ``top`` of any query, as ties go to the smaller id.
    """
    first = Window.partitionBy("mark").orderBy("vec_id")
    clean = scratch.write(_clean(vectors, dimension, kind), "clean")
    least = clean.dropDuplicates(["mark", "vec_id"]).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= top + 1)
    classes = least.groupBy("mark").agg(F.array_sort(F.collect_list("vec_id")).alias("members"), F.first("vector").alias("vector"))
    classes = scratch.write(classes, "classes")
    n = classes.count()
    some = hashed_sample(classes.select("mark", "vector"), ["mark"], sample, total=n, label="codebooks").toArrow()
    rows = sorted(zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True))
    if not rows:
        return classes.select("members", "vector", F.lit(b"").alias("codes"), F.lit(1.0).alias("norm")), np.zeros((0, 0, dimension), np.float32)
    books = fit_codebooks(_directions([r[1] for r in rows], dimension, kind)[0], codebooks=codebooks)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2_048):
                part = batch.slice(a, 2_048)
                x, norm = _directions(part.column(1).to_pylist(), dimension, kind)
                codes, decoded = encode(x, books)
                size = np.linalg.norm(decoded.astype(np.float64), axis=1)
                stored = norm / np.where(size > 0, size, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(stored)], ["members", "vector", "codes", "norm"])

    dealt = classes.select("members", "vector").repartition(F.xxhash64("vector"))
    return scratch.write(dealt.mapInArrow(code, "members array<bigint>, vector binary, codes binary, norm double"), "index"), books


def _search(index: DataFrame, books: np.ndarray, ids: np.ndarray, queries: np.ndarray, *, total: int, top: int, rerank: int) -> DataFrame:
    """(query_id, found): per task and query its ``top`` nearest, as packed ids and scores."""
    dimension, kind = queries.shape[1], queries.dtype.str
    unit = _directions([queries.tobytes()], dimension, kind)[0]
    held = index.sparkSession.sparkContext.broadcast((books, ids, queries, unit))  # QUERY_BLOCK queries at most

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, ids, queries, unit = held.value
        best_id = np.full((len(ids), top), np.iinfo(np.int64).max)
        best = np.full((len(ids), top), -np.inf)

        def block(members: list[list[int]], raw: list[bytes], codes: list[bytes], norm: np.ndarray) -> None:
            x = np.frombuffer(b"".join(raw), kind).reshape(-1, dimension).astype(np.float64)
            c = np.frombuffer(b"".join(codes), np.uint8).reshape(len(x), -1)
            expect = max(rerank, RERANK_SHARE * total) * len(x) / max(1, total)
            keep = min(len(x), int(expect + 6 * expect**0.5) + 24)
            width = max(map(len, members))
            own = np.full((len(x), width), -1, np.int64)
            for i, m in enumerate(members):
                own[i, : len(m)] = m
            for a in range(0, len(ids), 64):
                q = slice(a, min(a + 64, len(ids)))
                score = np.zeros((q.stop - a, len(x)), np.float32)
                for m in range(len(books)):
                    score += np.take(unit[q] @ books[m].T, c[:, m], axis=1)
                score *= (norm / norm.max()).astype(np.float32)
                near = np.argpartition(-score, keep - 1, axis=1)[:, :keep] if keep < len(x) else np.tile(np.arange(len(x)), (q.stop - a, 1))
                # summed from the first component on, so that a score does not depend on blocks
                exact = np.zeros(near.shape)
                for d in range(dimension):
                    exact += queries[q, d, None].astype(np.float64) * x[near, d]
                cand = own[near].reshape(q.stop - a, -1)
                value = np.repeat(exact, width, axis=1)
                value = np.where((cand < 0) | (cand == ids[q, None]), -np.inf, value)
                cand, value = np.hstack([best_id[q], cand]), np.hstack([best[q], value])
                order = np.lexsort((cand, -value), axis=1)[:, :top]
                best_id[q], best[q] = np.take_along_axis(cand, order, 1), np.take_along_axis(value, order, 1)

        rows: tuple[list, list, list, list] = ([], [], [], [])
        for batch in batches:
            for col, more in zip(rows, (c.to_pylist() for c in batch.columns), strict=True):
                col.extend(more)
            while len(rows[0]) >= BLOCK:
                block(rows[0][:BLOCK], rows[1][:BLOCK], rows[2][:BLOCK], np.array(rows[3][:BLOCK]))
                rows = tuple(r[BLOCK:] for r in rows)
        if rows[0]:
            block(rows[0], rows[1], rows[2], np.array(rows[3]))
        for a in range(0, len(ids), 1_024):
            n = min(1_024, len(ids) - a)
            found = [best_id[a + i].tobytes() + best[a + i].tobytes() for i in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + n]), pa.array(found, pa.binary())], ["query_id", "found"])

    return index.select("members", "vector", "codes", "norm").mapInArrow(search, "query_id long, found binary")


def _merge(parts: DataFrame, top: int) -> DataFrame:
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, scores = None, [], []

        def out() -> pa.RecordBatch:
            i, s = np.concatenate(ids), np.concatenate(scores)
            order = np.lexsort((i, -s))[:top]
            order = order[s[order] > -np.inf]
            return pa.RecordBatch.from_arrays([pa.array([now] * len(order), pa.int64()), pa.array(np.arange(1, len(order) + 1), pa.int32()), pa.array(i[order]), pa.array(s[order])], ["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for q, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if q != now and ids:
                    yield out()
                    ids, scores = [], []
                now, half = q, len(found) // 2
                ids.append(np.frombuffer(found[:half], np.int64)), scores.append(np.frombuffer(found[half:], np.float64))
        if ids:
            yield out()

    dealt = parts.repartition("query_id").sortWithinPartitions("query_id")
    return dealt.mapInArrow(merge, "query_id long, rank int, vec_id long, score double")


def nearest(spark: SparkSession, vectors: DataFrame, *, every: int = 20, top: int = 20, sample: int = SAMPLE, codebooks: int = CODEBOOKS, rerank: int = RERANK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``top`` nearest of each query by inner product.

    Queries are the rows of ``vectors(vec_id, embedding)`` whose vec_id is divisible by ``every``,
    taken in blocks against all rows but those of their own vec_id; ties go to the smaller vec_id.
    Vectors that are null, empty, zero, hold null or non-finite components, or have no vec_id take no part. Float components stay
    float, all others are doubles; scores are sums of doubles. Vectors of several lengths have an index for each length, as there is no product
    between lengths. Rows that repeat vec_id and vector count once; where one vec_id has
    several vectors, each is a candidate, and the query is the one whose bytes are smallest. No usable vector:
    no rows. Extra columns are not read.
    """
    small_batches(spark)
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>" if element == "float" else "array<double>").alias("embedding"))
    is_query = (F.col("vec_id") % every == 0).cast("int")
    lengths = rows.where("vec_id IS NOT NULL AND size(embedding) > 0").groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"), F.sum(is_query).alias("q"))
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for d in sorted(r.d for r in lengths.where("q > 0 AND n > 1").collect()):
        for part in _nearest(spark, rows, d, "<f4" if element == "float" else "<f8", every=every, top=top, sample=sample, codebooks=codebooks, rerank=rerank):
            out = out.unionByName(part)
    return out


def _nearest(spark: SparkSession, vectors: DataFrame, dimension: int, kind: str, *, every: int, top: int, sample: int, codebooks: int, rerank: int) -> Iterator[DataFrame]:
    """The results of one length, a table for each block of queries."""
    scratch = Scratch(spark, "nearest")
    index, books = build_index(vectors, scratch, dimension=dimension, kind=kind, top=top, sample=sample, codebooks=codebooks)
    if not len(books):
        return
    clean = spark.read.parquet(f"{scratch.root}/clean")
    asked = clean.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = scratch.write(asked.repartitionByRange(F.col("vec_id")).sortWithinPartitions("vec_id"), "queries")
    total, n = index.count(), asked.count()
    blocks = -(-n // QUERY_BLOCK)
    for k in range(blocks):  # one block of queries at a time is on the driver
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == k) if blocks > 1 else asked
        got = block.toArrow()
        if not got.num_rows:
            continue
        ids = got.column(0).to_numpy()
        queries = np.frombuffer(b"".join(got.column(1).to_pylist()), kind).reshape(-1, dimension)
        yield scratch.write(_merge(_search(index, books, ids, queries, total=total, top=top, rerank=rerank), top), f"found-{k}")
