"""Exact Jaccard join of word-shingle sets by pivots in metric spaces.

The Jaccard distance d = 1 - |A∩B| / |A∪B| is a metric, on whole sets and on their restrictions
to any part of the shingle universe. The join looks for all pairs with d <= r.

*Projected regions: a signature join.* Pivots taken among the documents alone cannot part a corpus: most
documents have distance 1 to every one of them, so the triangle window (distance to a foreign pivot at most
that to the own pivot + 2r) copies nearly every document into every region. So the space is first split
recursively: a node holds a document's shingles whose hash starts with certain bits, a node
with more than ``leaf`` shingles splits on the next bit. With ``leaf`` = floor(1/r) - 2, a
restriction of at most ``leaf`` shingles has no other restriction within distance r, since one shingle
more or less already gives 1/(leaf+1) > r: each distinct leaf content would be a pivot whose
Voronoi region within the window holds only documents at distance 0 from it. No distance is computed here: the
hash of a leaf's content is the key of an equi-join, and a document is replicated into the region of each
of its leaves.

*Why no pair is lost.* Follow the two documents down the tree until one of them has a leaf; equal
contents always split alike. Where the contents differ, one side has at most ``leaf`` shingles, so the
restricted similarity is at most leaf/(leaf+1). If w shingles of the union lie in equal leaves,
|A∩B| <= w + (|A∪B| - w) leaf/(leaf+1), hence w >= |A∪B| (1 - r(leaf+1)) for similarity 1-r:
a tenth of the union for r = 0.1, leaf = 8. Each document leaves out its smallest leaves as long as
they hold less than a quarter of that share of its own shingles; leaves kept by both with half that share remain. So the shingles of
common leaves are added up by pair, and what a common line alone brings together parts again; see :func:`_close_sets`. Pairs
left must be near by their sketches, too (:func:`_near_pairs`).
Pivots are for the large clusters that are left, each one region.

*Regions by pivots.* Within a region, documents are points of the L1 space of count sketches, a contraction of the
symmetric difference. Two documents within r differ in at most r/(2-r) (|A|+|B|) shingles, the bound; so the triangle
inequality never loses a pair. A region of a few members takes pivots greedily in one task. A hot region is dealt out
over many tasks, each with all of the region's pivots: members within a bound of a pivot leave the region, and
all members within the window (those, and one bound more) are replicated to that pivot's candidate cluster. What no
pivot holds is joined again: small remainders as any other region, hot ones by a further projection with
other hash bits, and so on; see :func:`_candidates`.

*Joining.* Candidate clusters are joined exactly: pivot distances first, and only pairs of different components whose
distances to every pivot differ by at most r are compared. A cluster of more members, or bytes, than one task
should hold is dealt out in blocks; see :func:`_join_clusters`.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import NOT_SPACE, U64, Scratch, Words, binaries, mix, slices, small_batches, texts_of

RUN_BYTES = 1 << 19
#: Members of a region, or of a cluster, that one task joins by itself, and bytes of a cluster's sets.
CLUSTER, CLUSTER_BYTES = 512, 4 << 20
#: Pivots of a hot region, how many bounds from a pivot a member leaves the region, and further projections at most.
PIVOTS, NEAR, PROJECTIONS = 16, 1, 4
#: Parts in which the members of large clusters are joined with what is known of the cluster.
SALTS = 32
#: Members up to which a region gives its pairs; links up to which one task finds their components (32 MB).
FEW, ONE_TASK = 8, 2_000_000
#: Rows of one key that a task holds before it passes them on as they come.
LONG_RUN = 1 << 16
#: Bits of the filter that tells which documents the last step reads again (4 MB, whatever the corpus).
FILTER_BITS = 1 << 25


# -- sets -----------------------------------------------------------------------------------------


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): row d's distinct shingles are the ascending ``hashes[first[d]:first[d+1]]``.

    A text with fewer words than ``words`` has its whole word sequence as its one shingle.
    """
    w = Words(raw, offsets, NOT_SPACE)
    h, at = w.grams(words)
    doc = w.doc[at]
    count = np.diff(w.first)
    for d in np.flatnonzero((count > 0) & (count < words)):
        x = count[d : d + 1].astype(U64)
        for k in range(w.first[d], w.first[d + 1]):
            x = mix(x * U64(0x9E3779B97F4A7C15) + w.hash[k : k + 1])
        h, doc = np.append(h, x), np.append(doc, d)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(w.n_docs + 1))


def _shared_bits(x: np.ndarray) -> np.ndarray:
    """Leading zero bits of each 64-bit word."""
    high, low = (x >> U64(32)).astype(np.float64), (x & U64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 - np.frexp(high)[1], 64 - np.frexp(low)[1])


def leaf_keys(h: np.ndarray, first: np.ndarray, leaf: int, spare: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """(keys, first): the region keys of each row's leaves; see :func:`leaves`."""
    key, _, at = leaves(h, first, leaf, spare)
    return key, at


def leaves(h: np.ndarray, first: np.ndarray, leaf: int, spare: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, masses, first): the region keys of each row's leaves, and how many shingles each leaf holds.

    Among ascending hashes a node of more than ``leaf`` shingles shows as ``leaf + 1`` in a row that
    share its bits, so the depth of a shingle's leaf is 1 + the most bits any such run around
    it shares. Rows leave out their smallest leaves while those hold less than ``spare`` of the row.
    """
    n, rows = len(h), len(first) - 1
    size = np.diff(first)
    depth = np.zeros(n, np.int64)
    k = n - leaf
    if k > 0:
        row = np.repeat(np.arange(rows), size)
        run = np.where(row[:k] == row[leaf:], _shared_bits(h[:k] ^ h[leaf:]) + 1, 0)
        for i in range(leaf + 1):
            np.maximum(depth[i : i + k], run, out=depth[i : i + k])
    prefix = np.where(depth > 0, h >> (U64(64) - np.minimum(depth, 63).astype(U64)), U64(0))
    head = np.ones(n, bool)
    head[1:] = (prefix[1:] != prefix[:-1]) | (depth[1:] != depth[:-1])
    head[first[:-1][size > 0]] = True
    start = np.flatnonzero(head)
    if not len(start):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    held = np.diff(np.append(start, n))
    key = mix(np.add.reduceat(mix(h), start) + depth[start].astype(U64) * U64(0x9E3779B97F4A7C15))
    row = np.searchsorted(first, start, "right") - 1
    # rows without shingles share their start with the next row; "right" already skips them
    by_size = np.zeros((rows, leaf + 1), np.int64)
    np.add.at(by_size, (row, held), held)
    small = np.cumsum(by_size, axis=1) * spare.denominator < size[:, None] * spare.numerator
    least = np.where(small.all(axis=1), leaf + 1, small.argmin(axis=1))  # sizes below it are left out
    keep = held >= least[row]
    return key[keep], held[keep], np.searchsorted(row[keep], np.arange(rows + 1))


def sketch(h: np.ndarray) -> bytes:
    """Counts of shingles by their leading bits; cells of neighbours can be added to get a smaller one."""
    bits = max(6, min(14, int(len(h)).bit_length() - 1))
    return np.minimum(np.bincount((h >> U64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def sketch_distances(some: list[bytes], others: list[bytes]) -> np.ndarray:
    """L1 distance of the sketches of each pair, at the width of the narrower one: never more than the symmetric difference."""
    out = np.zeros(len(some), np.int64)
    widths = np.array([(len(x), len(y)) for x, y in zip(some, others, strict=True)], np.int64).reshape(-1, 2)
    for m, n in np.unique(widths, axis=0).tolist():
        rows = np.flatnonzero((widths == (m, n)).all(axis=1))
        for k in range(0, len(rows), 1_000):
            part = rows[k : k + 1_000]
            x, y = (np.frombuffer(b"".join(v[i] for i in part), np.uint8).reshape(len(part), min(m, n), -1).sum(axis=2, dtype=np.int32) for v in (some, others))
            out[part] = np.abs(x - y).sum(axis=1)
    return out


# -- regions --------------------------------------------------------------------------------------


def _stage(docs: DataFrame, words: int, leaf: int, spare: Fraction) -> DataFrame:
    """Per row: size and two sums of hashes of its set, ``node``, a hash of all three that names the set, a sketch and its leaves."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = texts_of(batch.column(1))
            for a, b in slices(offsets, RUN_BYTES):
                h, first = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                keys, held, at = leaves(h, first, leaf, spare)
                size = np.diff(first)
                some = np.append(np.zeros(1, U64), np.cumsum(mix(h), dtype=U64))
                more = np.append(np.zeros(1, U64), np.cumsum(mix(h ^ U64(0xA5A5A5A5A5A5A5A5)), dtype=U64))
                x, y = (x[first[1:]] - x[first[:-1]] for x in (some, more))
                node = mix(mix(x + size.astype(U64)) + y)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(size, pa.int64()), pa.array(node.view(np.int64)),
                     pa.array([sketch(h[i:j]) for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary()),
                     binaries(keys.view(np.uint8), at * 8), binaries(held.astype("<u2").view(np.uint8), at * 2)],
                    ["doc_id", "n_shingles", "node", "sketch", "keys", "masses"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        sets, "doc_id long, n_shingles long, node long, sketch binary, keys binary, masses binary"
    )


def _explode_keys(staged: DataFrame) -> DataFrame:
    """(key, id, held): for each leaf its key, the set's node, and size * 65536 + mass. Copies that stand together count once."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2_000):
                part = batch.slice(i, 2_000)
                part = part.take(pa.array(np.unique(part.column(0).to_numpy(), return_index=True)[1]))
                node, size = (part.column(k).to_numpy() for k in (0, 1))
                n = pc.binary_length(part.column(2)).to_numpy() // 8
                key = np.frombuffer(b"".join(part.column(2).to_pylist()), np.int64)
                mass = np.frombuffer(b"".join(part.column(3).to_pylist()), "<u2").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(node, n)), pa.array(np.repeat(size, n) * 65536 + mass)], ["key", "id", "held"])

    return staged.select("node", "n_shingles", "keys", "masses").mapInArrow(explode, "key long, id long, held long")


def _meet(keyed: DataFrame, order: list[str], most: int, r: Fraction, *, stars: bool) -> DataFrame:
    """(a, b, na, nb, mass) of regions with more than one member, by one sort of ``keyed(key, id, held, ...)``.

    Regions of at most ``most`` members give their pairs, unless the sizes na and nb rule out a link. Those of more give one
    row for each member, with nb = 0: (member, key, size, 0, mass), or with ``stars`` (first member, member, size, 0, mass).
    """
    keep = 1 - r

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre: tuple[np.int64, np.int64] | None = None  # key and first member of a run that goes on
        held = np.zeros((3, 0), np.int64)

        def rows(*columns: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "na", "nb", "mass"])

        def hot(x: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
            n, mass = x[2] >> 16, x[2] & 65535
            return rows(first, x[1], n, np.zeros(len(n), np.int64), mass) if stars else rows(x[1], x[0], n, np.zeros(len(n), np.int64), mass)

        def out(x: np.ndarray) -> Iterator[pa.RecordBatch]:
            head = np.flatnonzero(np.append(True, x[0, 1:] != x[0, :-1]))
            m = np.diff(np.append(head, x.shape[1]))
            run, many = np.repeat(np.arange(len(m)), m), np.repeat(m > most, m)
            if many.any():
                yield hot(x[:, many], x[1, head][run[many]])
            few = np.repeat((m > 1) & (m <= most), m)
            x, run = x[:, few], run[few]
            for d in range(1, min(most, x.shape[1])):
                i = np.flatnonzero(run[:-d] == run[d:])
                if not len(i):
                    break
                p, q = x[:, i], x[:, i + d]
                swap = p[1] > q[1]
                p, q = np.where(swap, q, p), np.where(swap, p, q)
                na, nb = p[2] >> 16, q[2] >> 16
                near = (na * keep.denominator >= nb * keep.numerator) & (nb * keep.denominator >= na * keep.numerator)
                yield rows(p[1, near], q[1, near], na[near], nb[near], (p[2] & 65535)[near])

        for batch in batches:
            x = np.concatenate([held, np.stack([batch.column(k).to_numpy() for k in range(3)])], axis=1)
            new = np.ones(x.shape[1], bool)
            new[1:] = (x[:2, 1:] != x[:2, :-1]).any(axis=0)
            x = x[:, new]
            if centre is not None:
                cut = int(np.argmax(x[0] != centre[0])) if (x[0] != centre[0]).any() else x.shape[1]
                # copies of the last member may follow in this batch; sums of masses only get larger by them
                if cut:
                    yield hot(x[:, :cut], np.full(cut, centre[1]))
                x = x[:, cut:]
            held = x
            if not x.shape[1]:
                continue
            centre = None
            cut = int(np.flatnonzero(x[0] != x[0, -1])[-1]) + 1 if (x[0] != x[0, -1]).any() else 0
            if cut:
                yield from out(x[:, :cut])
            held = x[:, cut:]
            if held.shape[1] > max(most, LONG_RUN):
                centre = (held[0, 0], held[1, 0])
                yield hot(held, np.full(held.shape[1], centre[1]))
                held = held[:, :0]
        if held.shape[1]:
            yield from out(held)

    dealt = keyed.repartition("key").sortWithinPartitions("key", *order, "id").select("key", "id", "held")
    return dealt.mapInArrow(runs, "a long, b long, na long, nb long, mass long")


def _close_sets(staged: DataFrame, share: Fraction, r: Fraction, scratch: Scratch) -> DataFrame:
    """(a, b): links between nodes that put all nodes within r of one another into one component.

    Two sets within r share leaves of at least ``share`` of their union. Each leaves out less than a quarter of that share
    of itself, so the leaves they both keep hold ``need`` = share (max - (na + nb) / 4) or more, at least half the share of either set.
    Masses of shared leaves are added up for each pair, in regions of at most ``FEW`` members. In hotter ones a pair
    shares no more than either set has there. So pairs without enough go, and sets that have less than half their share in
    hot regions take no part in these: that parts what a common line brings together. The others meet again by themselves; regions
    still hot become stars around the set that has most of itself in hot regions: within a group of near copies, what they were copied from.
    """
    num, den = share.numerator, share.denominator
    met = scratch.write(_meet(_explode_keys(staged), [], FEW, r, stars=False), "met")
    hot = met.where("nb = 0").select(F.col("a").alias("id"), F.col("b").alias("key"), F.col("na").alias("n"), "mass")
    need = lambda mass: 4 * den * mass >= num * (4 * F.greatest("na", "nb") - F.col("na") - F.col("nb"))
    whole = scratch.write(hot.groupBy("id").agg(F.sum("mass").alias("hot"), F.max("n").alias("n")), "hot")
    pairs, stars = met.where("nb > 0"), None
    some = whole.where(2 * den * F.col("hot") >= num * F.col("n"))
    if any_hot := not whole.isEmpty():
        again = hot.join(some.select("id", (-F.col("hot") / F.col("n")).alias("rank")), "id")
        again = again.select("key", "id", (F.col("n") * 65536 + F.col("mass")).alias("held"), "rank")
        again = scratch.write(_meet(again, ["rank"], FEW, r, stars=True), "met-again")
        pairs = pairs.unionByName(again.where("nb > 0"))
        stars = again.where("nb = 0 AND a <> b").select("a", "b").distinct()
    pairs = pairs.groupBy("a", "b").agg(F.sum("mass").alias("mass"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    columns = ["a", "b", "na", "nb"]
    if not any_hot:
        return _near_pairs(scratch.write(pairs.where(need(F.col("mass"))).select(*columns), "pairs"), staged, r, scratch)
    pairs = scratch.write(pairs, "pairs")
    side = lambda c: whole.select(F.col("id").alias(c), F.col("hot").alias(f"hot_{c}"))
    more = pairs.where(~need(F.col("mass"))).join(side("a"), "a").join(side("b"), "b")
    more = more.where(need(F.col("mass") + F.least("hot_a", "hot_b")))
    pairs = scratch.write(pairs.where(need(F.col("mass"))).select(*columns).unionByName(more.select(*columns)), "pairs-left")
    return _near_pairs(pairs, staged, r, scratch).unionByName(stars)


def _near_pairs(pairs: DataFrame, staged: DataFrame, r: Fraction, scratch: Scratch) -> DataFrame:
    """(a, b) of the written table ``pairs(a, b, na, nb)`` whose sketches are no further apart than sets within r of one another can be.

    Sketches are a tenth of the sets' bytes, so that most of what shares leaves without being near goes before any set is read again.
    """
    ids = scratch.write(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "pair-nodes")
    marks = staged.select("node", "sketch").join(ids, "node", "left_semi").groupBy("node").agg(F.first("sketch").alias("sketch"))
    marks = scratch.write(marks, "pair-sketches")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            d = sketch_distances(batch.column(4).to_pylist(), batch.column(5).to_pylist())
            keep = d * (2 * r.denominator - r.numerator) <= r.numerator * sizes
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in (0, 1)], ["a", "b"])

    side = lambda c: marks.select(F.col("node").alias(c), F.col("sketch").alias(f"sketch_{c}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sketch_a", "sketch_b")
    return rows.mapInArrow(near, "a long, b long")


def _components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) of the nodes of the written table ``links(a, b)``; up to ``ONE_TASK`` links in one task, which needs no rounds."""
    if links.count() > ONE_TASK:
        return scratch.write(connected_components(links, scratch, name=name), f"{name}-found")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([b.column(k).to_numpy() for k in (0, 1)]) for b in batches if b.num_rows]
        if not parts:
            return
        ids, at = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
        a, b = at.reshape(2, -1)
        up = np.arange(len(ids))
        while True:  # every root takes the smallest root that it is linked with; ids ascend, so that is the smallest id
            x, y = up[a], up[b]
            if (x == y).all():
                break
            np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
            while ((z := up[up]) != up).any():
                up = z
        for i in range(0, len(ids), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 50_000]), pa.array(ids[up[i : i + 50_000]])], ["id", "component"])

    return scratch.write(links.select("a", "b").coalesce(1).mapInArrow(join, "id long, component long"), f"{name}-found")


def _regions(keyed: DataFrame) -> DataFrame:
    """(region, id, n) of regions with n > 1 members; regions with the same members become one.

    The members of a very long run pass through as they come: it stays a region of its own, n is then a lower bound.
    """

    def rows(region: np.ndarray, own: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(region.view(np.int64)), pa.array(own), pa.array(n)], ["region", "id", "n"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: list[np.ndarray], ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            key, own = np.concatenate(keys), np.concatenate(ids)
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            n = np.diff(np.append(head, len(key)))
            if (n > 1).any():
                region = mix(np.add.reduceat(mix(own.view(U64) + U64(0x9E3779B97F4A7C15)), head) + n.astype(U64))
                keep = np.repeat(n > 1, n)
                yield rows(np.repeat(region, n)[keep], own[keep], np.repeat(n, n)[keep])

        keys: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        long: np.int64 | None = None
        for batch in batches:
            key, own = (batch.column(k).to_numpy() for k in (0, 1))
            if long is not None:
                cut = int(np.searchsorted(key, long, "right"))
                if cut:
                    yield rows(mix(key[:cut].view(U64)), own[:cut], np.full(cut, LONG_RUN))
                key, own = key[cut:], own[cut:]
            if not len(key):
                continue
            long = None
            cut = int(np.searchsorted(key, key[-1]))  # the last run may go on in the next batch
            if keys and (cut or keys[-1][-1] != key[-1]):
                yield from out([*keys, key[:cut]], [*ids, own[:cut]])
                keys, ids = [], []
            elif cut:
                yield from out([key[:cut]], [own[:cut]])
            keys.append(key[cut:])
            ids.append(own[cut:])
            if sum(map(len, keys)) > LONG_RUN:
                key, own, long = np.concatenate(keys), np.concatenate(ids), keys[-1][-1]
                yield rows(mix(key.view(U64)), own, np.full(len(key), LONG_RUN))
                keys, ids = [], []
        if keys:
            yield from out(keys, ids)

    dealt = keyed.repartition("key").sortWithinPartitions("key", "id")
    return dealt.mapInArrow(runs, "region long, id long, n long").distinct()


class _Union:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while (x := self.up[self.up]).tobytes() != self.up.tobytes():
            self.up = x
        return self.up

    def join(self, a: int, others: np.ndarray) -> list[int]:
        """Members of ``others`` that joining really connected something for."""
        up, made = self.roots(), []
        seen = {int(up[a])}
        for x in others.tolist():
            if int(up[x]) not in seen:
                seen.add(int(up[x]))
                made.append(x)
        if len(seen) > 1:
            self.up[np.isin(up, list(seen))] = min(seen)
        return made


def bounds_from(sizes: np.ndarray, sketches: list[bytes], pivots: list[bytes], r: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """(distances, whole), both (members, pivots): distances in the sketch space, in bounds of the member.

    A member's bound is the most shingles in which it differs from any set within r of it. Distances are taken at the
    width of the pivot's sketch, where they obey the triangle inequality (``whole``), or at the member's, if that is narrower: then they are
    too small if anything. So what is whole and within ``NEAR`` bounds of a pivot may leave: anything within r of it is seen in
    the window.
    """
    out, whole = np.zeros((len(sizes), len(pivots))), np.zeros((len(sizes), len(pivots)), bool)
    bound = sizes * float(r / (2 - r) * (1 + 1 / (1 - r)))
    widths = np.array([len(x) for x in sketches])
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        cells = np.frombuffer(b"".join(sketches[k] for k in rows), np.uint8).reshape(len(rows), width).astype(np.int32)
        folded = {width: cells}
        for j, p in enumerate(pivots):
            w = min(width, len(p))
            if w not in folded:
                folded[w] = cells.reshape(len(rows), w, -1).sum(axis=2)
            own = np.frombuffer(p, np.uint8).astype(np.int32).reshape(w, -1).sum(axis=1)
            out[rows, j] = np.abs(folded[w] - own).sum(axis=1) / bound[rows]
            whole[rows, j] = w == len(p)
    return out, whole


def _window(r: Fraction) -> float:
    """Bounds from a pivot within which anything is that is near a member that left; bounds differ by 1/(1-r) at most."""
    return NEAR / float(1 - r) + 1 + 1e-9


def candidate_links(ids: np.ndarray, sizes: np.ndarray, sketches: list[bytes], r: Fraction) -> list[tuple[int, int]]:
    """Links that join, in one region, all members that can lie within distance r of one another.

    The smallest member that is free becomes a pivot; members near it leave, and what is in its window is linked with it. The clusters may
    be larger than needed; they are never smaller.
    """
    order = np.lexsort((ids, sizes))
    ids, sizes, links = ids[order], sizes[order], []
    marks = [sketches[k] for k in order]
    union, free = _Union(len(ids)), np.ones(len(ids), bool)
    while free.any():
        p = int(np.argmax(free))
        free[p] = False
        # whatever is within r of a member that leaves now is not larger than this
        rest = np.flatnonzero(free & (sizes * float(1 - r) ** 2 <= sizes[p] * (1 + 1e-9)))
        if len(rest):
            d, whole = bounds_from(sizes[rest], [marks[k] for k in rest], [marks[p]], r)
            # only links that connect something: a forest, whatever the number of pairs
            links += [(int(ids[p]), int(ids[x])) for x in union.join(p, rest[d[:, 0] <= _window(r)])]
            free[rest[whole[:, 0] & (d[:, 0] <= NEAR) & (sizes[rest] * float(1 - r) <= sizes[p] * (1 + 1e-9))]] = False
    return links


def _cluster_links(regions: DataFrame, sketches: DataFrame, r: Fraction) -> DataFrame:
    """Candidate links of regions of at most ``CLUSTER`` members, each joined in one task."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sizes, marks = None, [], [], []

        def out() -> pa.RecordBatch:
            links = candidate_links(np.array(ids), np.array(sizes), marks, r)
            a, b = zip(*links, strict=True) if links else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(4)]
            for region, i, n, s in zip(*cols, strict=True):
                if region != now and ids:
                    yield out()
                    ids, sizes, marks = [], [], []
                now = region
                ids.append(i), sizes.append(n), marks.append(s)
        if ids:
            yield out()

    rows = regions.join(sketches, "id")
    dealt = rows.select("region", "id", "n_shingles", "sketch").repartition("region").sortWithinPartitions("region")
    return dealt.mapInArrow(join, "a long, b long").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _peel(rows: DataFrame, r: Fraction, cap: int) -> DataFrame:
    """(region, id, pivot): for hot regions, links to pivots in whose window a member is; and null for those that stay.

    A member within ``NEAR`` bounds of some pivot has left the region. Anything within r of it is within one bound
    more of that pivot (bounds differ by 1/(1-r) at most), so is in its window. A member is linked with the first pivot in whose
    window it is, and pivots that share a member with one another: a forest, not all pairs. The order of pivots hangs on their ids
    alone, so a group that makes many hot regions has the same pivots in most of them, and links repeat.
    """
    hashed = F.xxhash64("id", F.lit("pivot"))
    first = Window.partitionBy("region").orderBy("hash", "id")
    # about four times as many as are needed are ranked: no region is gathered for its pivots
    some = rows.withColumn("hash", F.pmod(hashed, F.lit(1 << 32))).where(F.col("hash") < F.lit(4 * PIVOTS) / F.col("n") * float(1 << 32))
    pivots = some.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= PIVOTS)
    parts = F.ceil(F.col("n") / cap).cast("int")
    columns = ["region", "part", "member", "id", "n_shingles", "sketch"]
    pivots = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("member", F.col("nth") - PIVOTS - 1).select(*columns)
    members = rows.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("member", F.lit(0)).select(*columns)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pivots, members = None, [], []

        def out() -> pa.RecordBatch:
            ids, sizes, sketches = zip(*members, strict=True)
            ids, region = np.array(ids), now[0]
            p_ids, _, p_sketches = zip(*pivots, strict=True) if pivots else ((), (), ())
            d, whole = bounds_from(np.array(sizes), list(sketches), list(p_sketches), r)
            left, held = (whole & (d <= NEAR)).any(axis=1), d <= _window(r)
            links, union = [], _Union(len(p_ids))
            for row in np.unique(held, axis=0):
                own = np.flatnonzero(row)
                if len(own):
                    links += [(p_ids[int(own[0])], p_ids[q]) for q in union.join(int(own[0]), own[1:])]
            some = np.flatnonzero(held.any(axis=1))
            links += zip(ids[some].tolist(), np.array(p_ids, np.int64)[held[some].argmax(axis=1)].tolist(), strict=True) if len(some) else []
            links += [(i, None) for i in ids[~left].tolist()]
            members.clear()
            i, pivot = zip(*links, strict=True) if links else ((), ())
            return pa.RecordBatch.from_arrays([pa.array([region] * len(i), pa.int64()), pa.array(i, pa.int64()), pa.array(pivot, pa.int64())], ["region", "id", "pivot"])

        for batch in batches:
            for region, part, member, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (region, part) != now or len(members) >= 512:
                    if members:
                        yield out()
                    if (region, part) != now:
                        now, pivots = (region, part), []
                (pivots if member < 0 else members).append(row)
        if members:
            yield out()

    dealt = pivots.unionByName(members).repartition("region", "part").sortWithinPartitions("region", "part", "member", "id")
    return dealt.mapInArrow(near, "region long, id long, pivot long")


def _project(rest: DataFrame, docs: DataFrame, words: int, leaf: int, spare: Fraction, level: int) -> DataFrame:
    """Regions within the hot regions of ``rest(region, id)``, by leaves of a tree over other hash bits."""
    seed = mix(np.array([level], U64))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.append(0, np.cumsum(pc.binary_length(batch.column(2)).to_numpy()))
            for i, j in slices(ends, RUN_BYTES):
                part = batch.slice(i, j - i)
                sets = [np.sort(mix(np.frombuffer(x.as_py(), U64) ^ seed)) for x in part.column(2)]
                key, first = leaf_keys(np.concatenate(sets), np.append(0, np.cumsum([len(x) for x in sets])), leaf, spare)
                n = np.diff(first)
                region = mix(key ^ np.repeat(part.column(0).to_numpy(), n).view(U64))
                yield pa.RecordBatch.from_arrays([pa.array(region.view(np.int64)), pa.array(np.repeat(part.column(1).to_numpy(), n))], ["key", "id"])

    sets = _sets_again(docs, rest.select("id"), words)
    # by a merge: a broadcast would put both Python steps into one stage, two workers for each task
    return _regions(rest.select("region", "id").hint("merge").join(sets, "id").select("region", "id", "hashes").mapInArrow(keys, "key long, id long"))


def _candidates(regions: DataFrame, sketches: DataFrame, docs: DataFrame, words: int, leaf: int, spare: Fraction, r: Fraction, scratch: Scratch, cap: int) -> DataFrame:
    """(a, b): links that put all members of a region within r of one another into one cluster.

    Regions of more than ``cap`` members are parted by pivots (:func:`_peel`); what no pivot holds, if it is still more than
    ``cap``, by the next projection. After ``PROJECTIONS`` of them, or when one multiplies the members instead of parting them (near
    copies of one text share leaves of any tree), a remainder becomes one cluster, which the exact join deals out.
    """
    small, hot, links = regions.where(F.col("n") <= cap), regions.where(F.col("n") > cap), []
    for level in range(PROJECTIONS + 1):
        if hot.isEmpty():
            break
        peeled = scratch.write(_peel(hot.join(sketches, "id"), r, cap), f"peeled-{level}")
        links.append(peeled.where("pivot IS NOT NULL").select(F.col("pivot").alias("a"), F.col("id").alias("b")))
        rest = peeled.where("pivot IS NULL").select("region", "id").distinct()
        rest = scratch.write(rest.join(rest.groupBy("region").agg(F.count("*").alias("n")), "region").where("n > 1"), f"rest-{level}")
        small = small.unionByName(rest.where(F.col("n") <= cap).select(*small.columns))
        rest = rest.where(F.col("n") > cap)
        if rest.isEmpty():
            break
        now = None if level == PROJECTIONS else scratch.write(_project(rest, docs, words, leaf, spare, level + 1), f"regions-{level + 1}")
        if now is None or now.count() > 2 * rest.count():
            links.append(rest.join(rest.groupBy("region").agg(F.min("id").alias("a")), "region").select("a", F.col("id").alias("b")))
            break
        small, hot = small.unionByName(now.where(F.col("n") <= cap)), now.where(F.col("n") > cap)
    out = _cluster_links(small.select("region", "id"), sketches, r)
    for more in links:
        out = out.unionByName(more.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return out.distinct()


# -- clusters -------------------------------------------------------------------------------------


def exact_links(sets: list[np.ndarray], r: Fraction, *, pivots: int = 32) -> list[tuple[int, int]]:
    """A spanning forest of the exact links (distance at most r) among ``sets``.

    Pivots are documents that no earlier pivot has within r; their distances to all members are
    computed and are exact links. What remains are pairs of members of different components;
    of these, only those whose distances to each of the first ``pivots`` pivots differ by at most r
    are compared (triangle inequality).
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    values, index = np.unique(np.concatenate(sets) if n else np.zeros(0, U64), return_inverse=True)
    first = np.append(0, np.cumsum(size))
    flag = np.zeros(len(values), np.int32)
    num, den = r.denominator - r.numerator, r.denominator
    union, links = _Union(n), []
    free, is_pivot = np.ones(n, bool), np.zeros(n, bool)
    far: list[np.ndarray] = []

    def near(p: int, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        mine = index[first[p] : first[p + 1]]
        flag[mine] = 1
        if only is None:
            both = np.add.reduceat(flag[index], first[:-1]) if len(index) else np.zeros(n, np.int64)
            sizes = size
        else:
            both = np.array([np.count_nonzero(flag[index[first[x] : first[x + 1]]]) for x in only], np.int64)
            sizes = size[only]
        flag[mine] = 0
        either = sizes + size[p] - both
        return both, either

    while free.any():
        p = int(np.argmax(free))
        free[p], is_pivot[p] = False, True
        both, either = near(p)
        link = both * den >= num * either
        link[p] = False
        links += [(p, x) for x in union.join(p, np.flatnonzero(link))]
        free &= ~link
        if len(far) < pivots:
            far.append(1 - both / either)
    rest = np.flatnonzero(~is_pivot)
    if len(rest) > 1:
        d = np.array(far)[:, rest]
        slack = float(r) + 1e-9
        for k, x in enumerate(rest):
            root = union.roots()
            other = rest[k + 1 :]
            look = (root[other] != root[x]) & (size[other] * den >= num * size[x]) & (size[x] * den >= num * size[other])
            if look.any():
                look[look] = (np.abs(d[:, k + 1 :][:, look] - d[:, k : k + 1]) <= slack).all(axis=0)
            if look.any():
                only = other[look]
                both, either = near(int(x), only)
                links += [(int(x), y) for y in union.join(int(x), only[both * den >= num * either])]
    return links


def _sets_again(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(id, hashes) of the documents whose id is in ``wanted(id)``, and of a few others.

    A filter of fixed size (not the ids) goes to the tasks; false positives fall out in the next join.
    """
    cells = wanted.select((F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)) + 1).alias("k"))
    rows = cells.groupBy(F.expr("bitmap_bucket_number(k)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(k))").alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in rows:  # at most FILTER_BITS / 32768 rows of 4 KB
        at = (row.bucket - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(bytes(row.bits), np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            k = batch.column(1).to_numpy()
            hit = np.flatnonzero(table[k >> 3] >> (k & 7).astype(np.uint8) & 1)
            if not len(hit):
                continue
            part = batch.take(pa.array(hit))
            raw, offsets = texts_of(part.column(2))
            for a, b in slices(offsets, RUN_BYTES):
                h, first = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), binaries(h.view(np.uint8), first * 8)], ["id", "hashes"])

    # Spark's bitmap functions put k + 1 into bucket 1 + k div 32768 at bit k mod 32768, lowest bit first
    k = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    return docs.where("doc_id IS NOT NULL").select("doc_id", k.cast("long").alias("k"), "text").mapInArrow(again, "id long, hashes binary")


def _block_links(rows: DataFrame, r: Fraction) -> DataFrame:
    """Exact links within each block of ``rows(block, id, hashes)``."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets = None, [], []

        def out() -> pa.RecordBatch:
            links = exact_links(sets, r)
            return pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in links], pa.int64()), pa.array([ids[b] for _, b in links], pa.int64())], ["a", "b"])

        for batch in batches:
            for block, i, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if block != now and ids:
                    yield out()
                    ids, sets = [], []
                now = block
                h = np.frombuffer(h.as_py(), U64)
                if not ids or ids[-1] != i or not np.array_equal(sets[-1], h):
                    ids.append(i)
                    sets.append(h)
        if ids:
            yield out()

    dealt = rows.select("block", "id", "hashes").repartition("block").sortWithinPartitions("block", "id")
    return dealt.mapInArrow(join, "a long, b long")


def _join_clusters(members: DataFrame, weights: DataFrame, sets: DataFrame, r: Fraction, scratch: Scratch, cluster: int) -> DataFrame:
    """Exact links of every cluster of ``members(id, component)``; ``weights(id, bytes)`` are the sizes of their sets.

    First round: a cluster of more than ``cluster`` members or ``CLUSTER_BYTES`` is dealt by hash into blocks,
    each of which is joined in one task, together with three of the cluster's members as pivots. For
    clusters of one block that is all. Second round, for the others: pairs within the cluster's largest
    component need no comparison, so only its strays are replicated against every block.
    """

    def blocks_for(n: str, bytes_: str) -> Column:
        return F.greatest(F.ceil(F.col(n) / cluster), F.ceil(F.col(bytes_) / CLUSTER_BYTES)).cast("int")

    weighed = members.join(weights, "id").withColumn("salt", F.pmod(F.xxhash64("id", F.lit("salt")), F.lit(SALTS)).cast("int"))
    salted = lambda rows: rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # only clusters of several blocks have a row to be joined, a copy for each salt, so no cluster's members meet in one task
    sizes = weighed.groupBy("component").agg(F.count("*").alias("g"), F.sum("bytes").alias("bytes")).select("component", blocks_for("g", "bytes").alias("k")).where("k > 1")
    once = weighed.join(salted(sizes), ["component", "salt"], "left").withColumn("k", F.coalesce("k", F.lit(1)))
    once = once.withColumn("home", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    once = scratch.write(once, "blocks")
    big = once.where("k > 1")
    key = lambda *c: F.xxhash64("component", *c)
    pivots = big.groupBy("component", "k").agg(F.min_by("id", F.xxhash64("id")).alias("p0"), F.min("id").alias("p1"), F.max("id").alias("p2"))
    pivots = pivots.select("component", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("home"), "p0", "p1", "p2")
    pivots = pivots.select("component", "home", F.explode(F.array_distinct(F.array("p0", "p1", "p2"))).alias("id"))
    first = once.select("id", key("home").alias("block")).unionByName(pivots.select("id", key("home").alias("block"))).distinct()
    links = scratch.write(_block_links(first.join(sets, "id"), r), "links-0")
    if big.isEmpty():
        return links
    labels = _components(links, scratch, "blocks-cc")
    own = big.join(labels.withColumnRenamed("component", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    counts = own.groupBy("component", "label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    main = counts.groupBy("component").agg(F.max_by(F.struct("label", "n", "bytes"), F.struct("n", "label")).alias("main"), F.sum("n").alias("g"), F.sum("bytes").alias("bytes"))
    main = main.select("component", F.col("main.label").alias("main"), (F.col("g") - F.col("main.n")).alias("strays"), (F.col("bytes") - F.col("main.bytes")).alias("stray_bytes"))
    main = main.select("component", "main", blocks_for("strays", "stray_bytes").alias("s")).where("s > 0")
    own = own.join(salted(main), ["component", "salt"])
    # pair of a block of strays and any block: a task holds at most about twice what one block does
    stray = own.where("label <> main").select(
        "id", "component", F.pmod(F.xxhash64("id", F.lit(1)), F.col("s")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"))
    every = own.select("id", "component", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("i"), F.col("home").alias("j"))
    # written, so that Spark knows how few these are and need not shuffle all sets for them
    pairs = scratch.write(stray.unionByName(every).select("id", key("i", "j").alias("block")).distinct(), "block-pairs")
    return links.unionByName(scratch.write(_block_links(pairs.join(sets, "id"), r), "links-1"))


# -- the operator ---------------------------------------------------------------------------------


def jaccard_components(
    spark: SparkSession, docs: DataFrame, *, words: int = 3, similarity: Fraction = Fraction(9, 10), cluster: int = CLUSTER
) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_shingles and component_id.

    Two documents link when the Jaccard similarity of their sets of ``words``-word shingles is at
    least ``similarity``; component_id is the smallest doc_id reachable. Documents without words, or with
    null text, have no shingle and are linked with nothing. A null doc_id takes no part in links; its
    component is null. Rows that repeat a doc_id are all returned, and count as one node whose links are
    those of any of its texts. Empty table: no rows. Other columns are not read.
    """
    r = 1 - similarity
    leaf = int(1 / r) - 2
    if leaf < 1 or similarity < Fraction(4, 5):
        raise ValueError("similarity must be at least 4/5")
    share = 1 - r * (leaf + 1)
    scratch = Scratch(small_batches(spark), "jaccard")
    staged = scratch.write(_stage(docs, words, leaf, share / 4), "staged")
    some = staged.where("n_shingles > 0 AND doc_id IS NOT NULL")
    close = scratch.write(_close_sets(some, share, r, scratch), "close")
    # from here on a set goes by the smallest doc_id that has it
    found = _components(close, scratch, "close-cc").withColumnRenamed("id", "node")
    classes = scratch.write(some.groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")), "classes")
    members = scratch.write(found.join(classes, "node").select(F.col("rep").alias("id"), "component").distinct(), "close-members")
    rows = some.select(F.col("doc_id").alias("id"), "n_shingles", "sketch").join(members.select("id").distinct(), "id", "left_semi")
    sketches = scratch.write(rows, "sketches")
    sizes = members.groupBy("component").agg(F.count("*").alias("n"))
    large = scratch.write(members.join(sizes.where(F.col("n") > cluster), "component").select(F.col("component").alias("region"), "id", "n"), "large")
    if not large.isEmpty():
        links = scratch.write(_candidates(large, sketches, docs, words, leaf, share / 2, r, scratch, cluster), "candidates")
        small = members.join(sizes.where(F.col("n") <= cluster), "component", "left_semi").select("id", "component")
        members = scratch.write(small.unionByName(_components(links, scratch, "clusters")), "members")
    sets = _sets_again(docs, members.select("id"), words)  # the few others fall out when sets meet their blocks
    weights = sketches.groupBy("id").agg((8 * F.sum("n_shingles")).alias("bytes"))
    exact = _join_clusters(members, weights, scratch.write(sets, "sets"), r, scratch, cluster)
    # a doc_id that repeats with other texts ties their classes together
    twice = some.groupBy("doc_id").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("doc_id")
    tied = some.select("doc_id", "node").join(twice, "doc_id").distinct().join(classes, "node").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    nodes = _components(scratch.write(exact.select("a", "b").unionByName(tied), "exact"), scratch, "nodes")
    several = classes.where("rep <> last").select("node", "rep")
    rows = staged.select("doc_id", "n_shingles", "node").join(several, "node", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    # sets of no shingles are equal, but linked with nothing
    rows = rows.withColumn("rep", F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("doc_id"))).join(nodes.withColumnRenamed("id", "rep"), "rep", "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"))


def without_copies(spark: SparkSession, docs: DataFrame, *, words: int = 5, similarity: Fraction = Fraction(4, 5)) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one stays for each group of near copies.

    Groups are the components of :func:`jaccard_components`; of each the text with the smallest doc_id stays. Rows that
    repeat doc_id and text count once. Texts that share a doc_id but differ are judged each by itself: all but one of them
    take part under a 64-bit hash instead of the id, so an unlinked one stays, with its doc_id. Rows without doc_id take no
    part and stay. Empty table: no rows.
    """
    scratch = Scratch(small_batches(spark), "copies")
    text = F.coalesce("text", F.lit(""))
    mark = F.struct(F.xxhash64(text).alias("x"), F.hash(F.reverse(text)).alias("y"), F.length(text).alias("z"))
    named = docs.where("doc_id IS NOT NULL")
    again = named.select("doc_id", mark.alias("mark")).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("mark").alias("least"))
    again = scratch.write(again.where("n > 1").select("doc_id", "least"), "again")
    if again.isEmpty():
        found = jaccard_components(spark, named, words=words, similarity=similarity)
        kept = named.join(found.where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi")
    else:
        several = named.withColumn("mark", mark).join(again, "doc_id").dropDuplicates(["doc_id", "mark"])
        node = F.when(F.col("mark") == F.col("least"), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "mark", F.lit("node")))
        nodes = named.join(again, "doc_id", "left_anti").withColumn("node", F.col("doc_id"))
        nodes = nodes.unionByName(several.withColumn("node", node).select(*nodes.columns))
        found = jaccard_components(spark, nodes.select(F.col("node").alias("doc_id"), "text"), words=words, similarity=similarity)
        found = found.select(F.col("doc_id").alias("node"), "component_id").distinct()
        first = found.join(nodes.select("node", "doc_id"), "node").groupBy("component_id").agg(F.min_by("node", F.struct("doc_id", "node")).alias("node"))
        kept = nodes.join(first.select("node"), "node", "left_semi")
    return kept.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
