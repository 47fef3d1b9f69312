"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Item and text are aligned word by word (match 2, mismatch -1, gap -1); the score is the share of the item's own
best score. Copies with a fifth of their words changed reach 0.7, unrelated text stays below 0.3. No alignment that
reaches the threshold is lost: let it score S (2 x threshold x n, for an item of n words) or more with m <= n
matches and x mismatches and gaps, so 2m - x >= S. Then

* at least m - 1 - x >= S - n - 1 of its matches follow a match with nothing between, so that many 2-grams
  of the item, at different places of it, stand in the text. Every 2-gram is a seed. Where S - n - 1 is not above 0
  (five words at 0.6), words are the seeds, of which m >= S / 2 match;
* it covers at most m + x <= 3n - S words of the text, so its seeds stand within so many.

So an item may leave out its most frequent seeds as long as they hold fewer of its places than an alignment must
have: at least one of the others, its *rare* seeds, stands in every text that is to be found. One reading of the
corpus counts the seeds, a second one finds rare seeds, and, where one stands, all seeds of its item; only where
enough of them stand together words are aligned. Items of fewer than five words count only where they stand whole
and unedited: their one seed is all of them.

Items are taken in blocks of a bounded number of words, so what goes to the tasks has a fixed size
however large the benchmark is; documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, Words, slices, small_batches, texts_of

SEED_WORDS, ALIGNED_WORDS = 2, 5
THRESHOLD = 0.6
#: Words of items that the driver and each task hold at a time.
BLOCK_WORDS = 1 << 20
RUN_BYTES = 1 << 19
#: Pairs of a seed's place and an item that are held at a time (a text with more is taken by itself).
RUN_HITS = 1 << 20


class _Table:
    """Seeds of one length, ascending, each with the items that hold it."""

    def __init__(self, words: int, seeds: np.ndarray, items: np.ndarray):
        self.words = words
        pairs, self.places = np.unique(np.rec.fromarrays([seeds, items], names="seed,item"), return_counts=True)
        self.seed, self.first, self.count = np.unique(pairs["seed"], return_index=True, return_counts=True)
        self.item = np.ascontiguousarray(pairs["item"])
        #: which pairs of seed and item are rare: all, until the corpus is counted
        self.rare = np.ones(len(self.item), bool)

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(places, number of the seed) of the seeds that stand in a run of texts."""
        h, at = w.grams(self.words)
        k = np.minimum(np.searchsorted(self.seed, h), len(self.seed) - 1)
        hit = np.flatnonzero(self.seed[k] == h)
        return at[hit], k[hit]

    def leave_out(self, seen: np.ndarray, need: np.ndarray) -> None:
        """Of every item the seeds that stand most often are not rare, while they hold fewer places than ``need``."""
        often = np.repeat(seen, self.count)
        order = np.lexsort((self.item, -often, self.item))
        own, held = self.item[order], np.cumsum(self.places[order])
        begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        before = held[begin] - self.places[order][begin]
        held = held - np.repeat(before, np.diff(np.append(begin, len(own))))
        self.rare[order] = held >= need[own]


class _Items:
    """One block of items as word hashes, with their seeds."""

    def __init__(self, rows: list[tuple[int, str]], threshold: float, least_words: int):
        rows = sorted(set(rows))
        texts = pa.array([t for _, t in rows], pa.string())
        raw, offsets = texts_of(texts)
        w = Words(raw, offsets, ALNUM)
        size = np.diff(w.first)
        keep = np.flatnonzero(size >= max(1, least_words))
        self.ids = [rows[k][0] for k in keep.tolist()]
        self.words = [w.hash[w.first[k] : w.first[k + 1]] for k in keep]
        self.size = n = size[keep]
        best = 2 * threshold * n  # floats: bounds are rounded to the side that finds more
        grams = np.ceil(best - n - 1 - 1e-6).astype(np.int64)
        #: seeds that an alignment has at least, and words of the text that it covers at most
        self.need = np.where(grams > 0, grams, np.maximum(1, np.ceil(best / 2 - 1e-6).astype(np.int64)))
        self.span = np.floor(3 * n - best + 1e-6).astype(np.int64)
        self.need[n < ALIGNED_WORDS], self.span[n < ALIGNED_WORDS] = 1, 1
        length = np.where(n < ALIGNED_WORDS, n, np.where(grams > 0, SEED_WORDS, 1))
        number = np.full(len(size), -1)
        number[keep] = np.arange(len(keep))
        self.tables = []
        # short items have their whole self as a seed: tables of whole items and of seeds are kept apart
        for words, short in sorted(set(zip(length.tolist(), (n < ALIGNED_WORDS).tolist(), strict=True))):
            h, at = w.grams(words)
            item = number[w.doc[at]]
            own = (length == words) & ((n < ALIGNED_WORDS) == short)
            mine = (item >= 0) & np.append(own, False)[item]
            self.tables.append(_Table(words, h[mine], item[mine]))


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """(score, first, last + 1) of the best local alignment of ``item`` within ``window``.

    Gaps along the window are a running maximum, so each word of the item is a few array operations.
    """
    n = len(window)
    slope = np.arange(n + 1)
    row, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for word in item:
        up, up_start = row - 1, start
        diag = np.where(window == word, 2, -1) + row[:-1]
        new, new_start = np.zeros(n + 1, np.int64), slope.copy()
        better = diag > 0
        new[1:][better], new_start[1:][better] = diag[better], start[:-1][better]
        better = up > new
        new[better], new_start[better] = up[better], up_start[better]
        # H[j] = max over k <= j of new[k] - (j - k)
        lifted = new + slope
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, slope, 0))
        row = top - slope
        row[row < 0] = 0
        start = np.where(row > 0, new_start[source], slope)
        k = int(row.argmax())
        if row[k] > best[0]:
            best = (int(row[k]), int(start[k]), k)
    return best


def _expand(table: _Table, of: int, doc: np.ndarray, at: np.ndarray, k: np.ndarray, rare: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc * of + item, place, item) of every pair of a hit and an item of its seed; whole texts, a bounded number at a time."""
    n = table.count[k]
    total = np.append(0, np.cumsum(n))
    a = 0
    while a < len(at):
        b = int(np.searchsorted(total, total[a] + RUN_HITS, "right")) - 1
        b = int(np.searchsorted(doc, doc[b])) if b < len(at) else b
        if b <= a:
            b = int(np.searchsorted(doc, doc[a], "right"))
        m = n[a:b]
        pair = np.repeat(table.first[k[a:b]] - (total[a:b] - total[a]), m) + np.arange(m.sum())
        place, key = np.repeat(at[a:b], m), np.repeat(doc[a:b], m)
        if rare:
            pair, place, key = pair[table.rare[pair]], place[table.rare[pair]], key[table.rare[pair]]
        yield key * of + table.item[pair], place, table.item[pair]
        a = b


def _close(w: Words, own: _Items) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, item, places of its seeds, those that begin a stretch with as many seeds as an alignment has)."""
    of = len(own.words)
    for table in own.tables:
        at, k = table.hits(w)
        doc = w.doc[at]
        # seeds that are rare for some item open a text; of an opened text all seeds of the items that they name are read
        some = np.logical_or.reduceat(table.rare, table.first)[k]
        named = [np.unique(key) for key, _, _ in _expand(table, of, doc[some], at[some], k[some], True)]
        if not any(map(len, named)):
            continue
        keys = np.concatenate(named)
        opened = np.isin(doc, keys // of)
        for key, place, item in _expand(table, of, doc[opened], at[opened], k[opened], False):
            mine = np.isin(key, keys)
            key, place, item = key[mine], place[mine], item[mine]
            order = np.argsort(key, kind="stable")
            key, place, item = key[order], place[order], item[order]
            last = np.arange(len(key)) + own.need[item] - 1
            begins = last < len(key)
            last[~begins] = 0
            begins &= (key[last] == key) & (place[last] - place < own.span[item])
            for one in np.unique(key[begins]).tolist():
                i, j = np.searchsorted(key, one), np.searchsorted(key, one, "right")
                yield *divmod(one, of), place[i:j], place[i:j][begins[i:j]]


def _found(own: _Items, column: pa.Array, threshold: float) -> Iterator[tuple]:
    """(row, item_id, score, first word, end word, seeds) of every item that a text of ``column`` holds."""
    raw, offsets = texts_of(column)
    for a, b in slices(offsets, RUN_BYTES):
        w = Words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM)
        for d, item, places, begins in _close(w, own):
            words, n, span = own.words[item], len(own.words[item]), int(own.span[item])
            low, high, best = int(w.first[d]), int(w.first[d + 1]), (0, 0, 0)
            if n < ALIGNED_WORDS:
                yield a + d, own.ids[item], 1.0, int(places[0]) - low, int(places[0]) - low + n, len(places)
                continue
            cuts = [0, *(np.flatnonzero(np.diff(begins) > 2 * span) + 1).tolist(), len(begins)]
            for i, j in zip(cuts, cuts[1:]):
                first, last = max(low, int(begins[i]) - span), min(high, int(begins[j - 1]) + span + 1)
                window = w.hash[first:last]
                # no alignment matches more words than the window has of the item
                if 2 * np.isin(words, window).sum() >= threshold * 2 * n:
                    score, s, e = align(words, window)
                    best = max(best, (score, -(first - low + s), first - low + e))
            if best[0] >= threshold * 2 * n:
                yield a + d, own.ids[item], best[0] / (2 * n), -best[1], best[2], len(places)


def _matches(docs: DataFrame, items: _Items, threshold: float) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(items)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_found(held.value, batch.column(1), threshold))
            if rows:
                d, *cols = zip(*rows, strict=True)
                ids = batch.column(0).take(pa.array(d))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()), strict=True))], ["doc_id", "item_id", "score", "first_word", "end_word", "n_seeds"])

    return docs.select("doc_id", "text").mapInArrow(find, "doc_id long, item_id long, score double, first_word long, end_word long, n_seeds long")


def _clean(docs: DataFrame, items: _Items, threshold: float) -> Callable[[Column], Column]:
    held = docs.sparkSession.sparkContext.broadcast(items)

    def clean(texts: pa.Array) -> pa.Array:
        out = np.ones(len(texts), bool)
        out[[row for row, *_ in _found(held.value, texts, threshold)]] = False
        return pa.array(out)

    return F.arrow_udf(clean, "boolean")


def _seen(docs: DataFrame, items: _Items) -> list[np.ndarray]:
    """How many documents hold each seed, over the whole corpus: one number for each seed of the block."""
    held = docs.sparkSession.sparkContext.broadcast([(t.words, t.seed) for t in items.tables])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [_Table(words, seed, np.zeros(len(seed), np.int64)) for words, seed in held.value]
        found = [np.zeros(len(t.seed), np.int64) for t in tables]
        for batch in batches:
            raw, offsets = texts_of(batch.column(0))
            for a, b in slices(offsets, RUN_BYTES):
                w = Words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM)
                for n, t in zip(found, tables, strict=True):
                    at, k = t.hits(w)
                    n += np.bincount(np.unique(w.doc[at] * len(t.seed) + k) % len(t.seed), minlength=len(t.seed))
        for t, n in enumerate(found):
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), t, np.int32)), pa.array(k), pa.array(n[k])], ["t", "k", "n"])

    rows = docs.select("text").mapInArrow(count, "t int, k long, n long").groupBy("t", "k").agg(F.sum("n").alias("n")).toArrow()
    out = [np.zeros(len(t.seed), np.int64) for t in items.tables]
    for t in range(len(out)):
        mine = rows.filter(pc.equal(rows.column("t"), t))
        out[t][mine.column("k").to_numpy()] = mine.column("n").to_numpy()
    return out


def _blocks(docs: DataFrame, benchmark: DataFrame, threshold: float, block_words: int, least_words: int) -> Iterator[_Items]:
    """Blocks of items with their seeds, and which of these are rare in ``docs``."""
    small_batches(docs.sparkSession)
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // (2 * block_words)))  # a word has two characters at least, with its gap
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect() if blocks > 1 else items.collect()
        own = _Items([(r.item_id, r.text) for r in rows], threshold, least_words)
        if own.ids:
            for table, seen in zip(own.tables, _seen(docs, own), strict=True):
                table.leave_out(seen, own.need)
            yield own


def without_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS, least_words: int = 1) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark item (see :func:`leaks`).

    Texts alone go to Python; nothing is joined or shuffled.
    """
    kept = docs
    for own in _blocks(docs, benchmark, threshold, block_words, least_words):
        kept = kept.where(_clean(docs, own, threshold)(F.col("text")))
    return kept


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS, least_words: int = 1) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds, exactly or edited.

    doc_id, item_id, score (0 to 1, at least ``threshold``), first_word, end_word (the aligned words of the
    document, from 0), n_seeds (places of the document where a seed of the item stands). Items of fewer than five words,
    which cannot be told from chance once edited, match where they stand whole (score 1, their first place); those of fewer than
    ``least_words``, or with null id or text or no word, match nothing. Null or empty document text: no
    match. Repeated documents: each its own rows; an item_id with several texts: a row for each that matches.
    Empty tables: no rows. Extra columns are not read.
    """
    out = None
    for own in _blocks(docs, benchmark, threshold, block_words, least_words):
        found = _matches(docs, own, threshold)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, score double, first_word long, end_word long, n_seeds long")
