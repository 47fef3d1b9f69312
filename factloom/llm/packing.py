"""Packing token sequences by shortest-pack-first over the length histogram.

A document is cut into full sequences and one rest. Only the histogram of piece lengths (at most
``size`` numbers) reaches the driver: lengths are placed longest first, each into the packs that
are shortest so far among those with room, and what results is a list of *packing patterns* with
counts, not of packs. Pieces then find their place by rank: the pieces of one length, in their order,
fill that length's slots in the patterns in theirs.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, byte_bpe, small_batches

SIZE = 1024
#: Encoded words that a worker keeps: few, as other operators share the worker.
KEEP = 300_000


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns ``(count, [(length, times), ...])`` that place every piece of the histogram.

    Longest pieces first, each goes into the shortest pack (the one with the most room), or into a new one where it
    does not fit there. Packs with equal contents are one pattern with a count, so a step moves a whole pattern from
    its room to the room that is left, where it takes part again; only the last step of a length splits a pattern in
    two. New packs take a length until they are full of it, as each of them is then the shortest. So a length adds at
    most two patterns, however many pieces it has.
    """
    rooms: list[tuple[int, int]] = []  # a heap of (-room, number of the pattern)
    patterns: list[tuple[int, list[tuple[int, int]]]] = []

    def put(count: int, pattern: list[tuple[int, int]], room: int) -> None:
        patterns.append((count, pattern))
        heapq.heappush(rooms, (-room, len(patterns) - 1))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and rooms and -rooms[0][0] >= length:
            room, k = rooms[0]
            count, pattern = patterns[k]
            used = min(count, left)
            left -= used
            last, times = pattern[-1]
            more = [*pattern[:-1], (length, times + 1)] if last == length else [*pattern, (length, 1)]
            if used < count:
                patterns[k] = (count - used, pattern)
                put(used, more, -room - length)
            else:
                patterns[k] = (count, more)
                heapq.heapreplace(rooms, (room + length, k))
        times = size // length
        for times, count in ((times, left // times), (left % times, 1)):
            if times and count:
                put(count, [(length, times)], size - times * length)
    return patterns


def slots_of(patterns: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Per run of equal slots: (length, first rank, last rank + 1, first sequence, offset, times).

    Rank r of ``length`` lies in sequence ``first sequence + (r - first rank) // times`` at offset
    ``offset + (r - first rank) % times * length``.
    """
    ranks: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for count, pattern in patterns:
        offset = 0
        for length, times in pattern:
            first = ranks[length]
            ranks[length] = first + count * times
            out.append((length, first, ranks[length], sequence, offset, times))
            offset += length * times
        sequence += count
    return out


def pieces_of(docs: DataFrame, *, vocabulary: str, end_id: int, size: int) -> DataFrame:
    """Cut pieces with their task's number and their rank among that task's pieces of one length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of, end = byte_bpe(vocabulary, KEEP), np.array([end_id], "<u4").tobytes()
        shard, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = ids_of(text.as_py()) + end
                n = len(ids) // 4
                for start in range(0, n, size):
                    length = min(size, n - start)
                    for col, x in zip(cols, (doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, seen[length]), strict=True):
                        col.append(x)
                    seen[length] += 1
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "local_rank")
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard] * len(cols[0]), pa.int64())} | {n: pa.array(c, pa.int64()) for n, c in zip(names, cols, strict=True)})

    return docs.select("doc_id", "text").mapInArrow(
        cut, "shard long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, local_rank long"
    )


def pack(spark: SparkSession, docs: DataFrame, *, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, size: int = SIZE) -> DataFrame:
    """Pack all documents into sequences of at most ``size`` ids; one row for each piece.

    Columns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens (what
    the sequence holds in all). Null text: empty, so one piece with the end id. Null doc_id and repeated
    rows: packed like any other. Empty table: no rows. Other columns are not read.
    """
    scratch = Scratch(small_batches(spark), "packing")
    pieces = scratch.write(pieces_of(docs, vocabulary=vocabulary, end_id=end_id, size=size), "pieces")
    counts = scratch.write(pieces.groupBy("shard", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    patterns = shortest_pack_first(histogram, size)
    rows = [(*s, k) for k, s in enumerate(slots_of(patterns))]
    totals, sequence = [], 0
    for count, pattern in patterns:
        totals.append((sequence, sequence + count, sum(n * t for n, t in pattern)))
        sequence += count
    held = {first: total for first, _, total in totals}
    slots = spark.createDataFrame(
        [(length, a, b, seq, off, times, held[seq]) for length, a, b, seq, off, times, _ in rows],
        "length long, rank_from long, rank_to long, first_sequence long, slot_offset long, times long, sequence_tokens long",
    )
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # bases grow with the number of tasks, so they are never broadcast
    ranked = pieces.join(bases.hint("merge"), ["shard", "length"]).withColumn("rank", F.col("base") + F.col("local_rank"))
    # the patterns number at most twice `size`, whatever the corpus: their slots are a bounded table
    placed = ranked.join(F.broadcast(slots), (ranked.length == slots.length) & (ranked.rank >= slots.rank_from) & (ranked.rank < slots.rank_to))
    nth = F.col("rank") - F.col("rank_from")
    return placed.select(
        "doc_id", "start", ranked.length, "ids_crc32", "doc_tokens",
        (F.col("first_sequence") + F.floor(nth / F.col("times"))).cast("long").alias("sequence_id"),
        (F.col("slot_offset") + (nth % F.col("times")) * ranked.length).alias("offset"), "sequence_tokens",
    )
