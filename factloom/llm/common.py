"""What the operators of this subpackage share: text hashing, tokenizing, Arrow helpers."""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.written import Written as Scratch  # noqa: F401  written intermediates

U64 = np.uint64


# -- Arrow helpers ------------------------------------------------------------------------------

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> SparkSession:
    """Let Arrow batches of texts hold 8 MB instead of the default 64 MB, unless the session has its own setting.

    A batch stands in the JVM and in the Python worker of every running task at once.
    """
    if spark.conf.get(BATCH_BYTES) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(BATCH_BYTES, str(8 << 20))
    return spark


def hashed_sample(rows: DataFrame, content: list[str], most: int | Column, *, total: int | Column, label: str, within: list[str] = ()) -> DataFrame:
    """At most ``most`` of ``rows`` (of each group of ``within``), chosen by a hash of ``content``; ``total`` is about how many contents there are.

    The hash is used at full width, so no share is too small for it; rows with equal content count once; and
    the smallest hashes are taken in the end, so the bound holds whatever the rows are.
    """
    h = F.xxhash64(*[F.col(c) for c in content], F.lit(label))
    wanted = 1.3 * F.lit(most).cast("double") / F.greatest(F.lit(total).cast("double"), F.lit(1.0))
    # a share of the hash's range, a third more than is wanted and never less than eight rows' worth
    wanted = F.greatest(wanted, 8.0 / F.greatest(F.lit(total).cast("double"), F.lit(1.0)))
    some = rows.withColumn("sample_hash", h).where((F.col("sample_hash").cast("double") / 2.0**64 + 0.5) < wanted)
    some = some.dropDuplicates([*within, "sample_hash"])
    first = Window.partitionBy(*(within or [F.lit(0)])).orderBy("sample_hash")
    return some.withColumn("sample_nth", F.row_number().over(first)).where(F.col("sample_nth") <= most).drop("sample_nth", "sample_hash")


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, without a copy of the bytes; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.LargeStringArray):
        column = column.cast(pa.string())
    n = len(column)
    _, offs, data = column.buffers()
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, np.int32, n + 1, column.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes (a longer row is a run of its own)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from one buffer and its byte offsets."""
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())]
    )


# -- words and shingles, on bytes ---------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over the whole word."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = U64(0xD6E8FEB86659FD93)  # odd, so it has an inverse modulo 2**64
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))


_KEPT: dict[int, np.ndarray] = {}


def _powers(n: int, base: np.uint64) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo 2**64; those of usual runs are kept."""
    held = _KEPT.get(int(base))
    if held is None or len(held) < n:
        out = np.full(max(n, 1 << 19), base, U64)
        out[0] = 1
        held = np.multiply.accumulate(out)
        if n <= 1 << 21:
            _KEPT[int(base)] = held
    return held[:n]


#: ``[^\x20\x09-\x0D]+`` and ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` as sets of UTF-8 bytes, after A-Z.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


class Words:
    """Word hashes of a run of texts, all at once.

    ``hash[k]`` is a 64-bit hash of the lower-cased word k, ``doc[k]`` its row within the run,
    ``start[k]`` and ``end[k]`` its byte range in the run's bytes.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, alphabet: np.ndarray):
        low = _LOWER[raw]
        inside = alphabet[low]
        edge = np.flatnonzero(np.diff(inside.view(np.int8)))
        # a word ends where its text does, too
        starts = np.concatenate([edge[inside[edge + 1]] + 1, [0] if len(inside) and inside[0] else []]).astype(np.int64)
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(raw))]
        cuts = np.unique(cuts[inside[cuts] & inside[cuts - 1]]) if len(cuts) else cuts
        starts = np.sort(np.concatenate([starts, cuts]))
        ends = np.concatenate([edge[~inside[edge + 1]] + 1, [len(raw)] if len(inside) and inside[-1] else []]).astype(np.int64)
        ends = np.sort(np.concatenate([ends, cuts]))
        sums = np.zeros(len(raw) + 1, U64)
        np.cumsum(_BYTE[low] * _powers(len(raw), _BASE), dtype=U64, out=sums[1:])
        inverse = _powers(len(raw) + 1, _INVERSE)
        self.hash = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64))
        self.start, self.end = starts, ends
        self.doc = np.searchsorted(offsets, starts, "right") - 1
        self.n_docs = len(offsets) - 1
        #: words of row d are first[d] to first[d + 1]
        self.first = np.searchsorted(self.doc, np.arange(self.n_docs + 1))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, position of the first word) of every n words that stand within one text."""
        k = len(self.hash) - n + 1
        if k <= 0:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:k] == self.doc[n - 1 :])
        h = np.zeros(len(at), U64)
        for i in range(n):
            h = mix(h * U64(0x9E3779B97F4A7C15) + self.hash[at + i])
        return h, at


# -- tokenizing ---------------------------------------------------------------------------------


class ByteBPE:
    """Ids of whole texts by the ``tokenizers`` library, as little-endian unsigned 32-bit bytes.

    The library splits a text into pieces by a fixed pattern and encodes each piece by itself.
    Pieces repeat, so their ids are kept (a bounded number of them); a text with characters
    whose class may differ between Unicode versions, or with a special token's string, is given to
    the library whole. Either way the ids are those of ``encode(text, add_special_tokens=False)``.
    """

    KEEP = 400_000
    #: The pattern's character classes within the characters that are not ``odd``.
    _LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
    _PIECES = rf" ?[{_LETTERS}]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+"

    def __init__(self, name: str):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.pieces = re.compile(self._PIECES).findall
        self.odd = re.compile(f"[^\t\n\r\x20-\x7e{self._LETTERS}]").search
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        if sys.byteorder == "little" and array("I").itemsize == 4:
            return [array("I", e.ids).tobytes() for e in found]
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.odd(text) or any(s in text for s in self.special):
            return self._encode([text])[0]
        pieces = self.pieces(text)
        known = self.known
        new = list(set(pieces).difference(known))
        if not new:
            return b"".join(map(known.__getitem__, pieces))
        known.update(zip(new, self._encode(new), strict=True))
        ids = b"".join(map(known.__getitem__, pieces))
        if len(known) > self.KEEP:  # full: what came first, and so is frequent, stays
            for piece in new:
                del known[piece]
        return ids


_BPE: dict[str, ByteBPE] = {}


def byte_bpe(name: str, keep: int = ByteBPE.KEEP) -> ByteBPE:
    """One per Python worker, keeping at most ``keep`` pieces."""
    if name not in _BPE:
        _BPE[name] = ByteBPE(name)
    bpe = _BPE[name]
    bpe.KEEP = keep
    if len(bpe.known) > keep:
        bpe.known.clear()
    return bpe
