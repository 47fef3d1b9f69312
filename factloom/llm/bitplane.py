"""Token-id files of shuffled planes: blocks of ids are transposed into byte or bit planes, each
plane is compressed by zstandard, and an index tells where every chunk and every document lies.

One *file* holds the ids of a run of documents, in ascending ``doc_id`` order::

    header   magic "IDPL", version, plane kind (1 bits, 8 bytes), ids per block,
             number of ids, of chunks, of documents            (little endian)
    chunks   per block of ids: number of ids, planes kept, crc32 of the ids,
             then per plane its offset and length in the body
    index    per document: number of ids
    body     the zstandard frames of the planes

Planes that hold only zeros are not stored. Files are rows of a written table, so Spark's commit
protocol makes each whole or absent, a lost executor costs one task, and any store that Spark can
write will do. Files are cut at ``file_ids`` ids; a document never straddles two files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, byte_bpe, small_batches

BLOCK_IDS = 65_536
FILE_IDS = 1 << 20
#: Encoded words that a worker keeps (about 130 MB).
KEEP = 800_000
LEVEL = 3
_HEAD = struct.Struct("<4sHHIQII")
_CHUNK = struct.Struct("<IIIQI")  # ids, planes kept (a mask), crc32, offset of the body, frames
_MAGIC = b"IDPL"


def _planes(ids: np.ndarray, bits: bool) -> np.ndarray:
    """Rows are planes, the lowest first."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
    if not bits:
        return np.ascontiguousarray(octets)
    each = np.unpackbits(np.ascontiguousarray(octets), axis=1, bitorder="little").reshape(4, -1, 8)
    return np.packbits(each.transpose(0, 2, 1).reshape(32, -1), axis=1, bitorder="little")


def _unplanes(planes: np.ndarray, n: int, bits: bool) -> np.ndarray:
    if bits:
        each = np.unpackbits(planes, axis=1, bitorder="little", count=n).reshape(4, 8, n)
        planes = np.packbits(each.transpose(0, 2, 1).reshape(4, -1), axis=1, bitorder="little")
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def encode_file(ids: np.ndarray, lengths: np.ndarray, *, bits: bool = False, block_ids: int = BLOCK_IDS, level: int = LEVEL) -> bytes:
    """The bytes of one file: ``ids`` of all its documents, ``lengths`` ids of each."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=level).compress
    ids = np.ascontiguousarray(ids, "<u4")
    chunks, sizes, body, at = [], [], [], 0
    for a in range(0, len(ids), block_ids):
        block = ids[a : a + block_ids]
        frames, mask = [], 0
        for k, plane in enumerate(_planes(block, bits)):
            if plane.any():
                mask |= 1 << k
                frames.append(pack(plane.tobytes()))
        chunks.append(_CHUNK.pack(len(block), mask, zlib.crc32(block.tobytes()), at, len(frames)))
        sizes += map(len, frames)
        body += frames
        at += sum(map(len, frames))
    head = _HEAD.pack(_MAGIC, 1, 1 if bits else 8, block_ids, len(ids), len(chunks), len(lengths))
    return b"".join([head, *chunks, np.array(sizes, "<u4").tobytes(), np.asarray(lengths, "<u8").tobytes(), *body])


def read_range(data: bytes, first: int, last: int) -> np.ndarray:
    """The ids ``first`` to ``last`` (exclusive) of a file: the chunk index says which frames hold them; only those are unpacked.

    Raises ValueError where a chunk that is read does not match its crc32, and IndexError outside the file.
    """
    import zstandard

    magic, version, width, block_ids, n_ids, n_chunks, n_docs = _HEAD.unpack_from(data)
    if magic != _MAGIC or version != 1:
        raise ValueError("not a file of token planes")
    if not 0 <= first <= last <= n_ids:
        raise IndexError(f"ids {first} to {last} of {n_ids}")
    if first == last:
        return np.empty(0, "<u4")
    unpack, bits = zstandard.ZstdDecompressor().decompress, width == 1
    low, high = first // block_ids, -(-last // block_ids)
    # the index alone is read up to the chunks that are wanted: how many frames lie before them
    chunks = [_CHUNK.unpack_from(data, _HEAD.size + k * _CHUNK.size) for k in range(high)]
    frames = _HEAD.size + n_chunks * _CHUNK.size
    n_frames = sum(_CHUNK.unpack_from(data, _HEAD.size + k * _CHUNK.size)[4] for k in range(n_chunks))
    sizes = np.frombuffer(data, "<u4", n_frames, frames)
    body = frames + 4 * n_frames + 8 * n_docs
    k, out = sum(c[4] for c in chunks[:low]), []
    for n, mask, crc, at, _ in chunks[low:]:
        planes = np.zeros((32, (n + 7) // 8) if bits else (4, n), np.uint8)
        where = body + at
        for p in (p for p in range(32) if mask >> p & 1):
            planes[p] = np.frombuffer(unpack(data[where : where + int(sizes[k])]), np.uint8)
            where += int(sizes[k])
            k += 1
        block = _unplanes(planes, n, bits)
        if zlib.crc32(block.tobytes()) != crc:
            raise ValueError("a chunk is damaged")
        out.append(block)
    return np.concatenate(out)[first - low * block_ids : last - low * block_ids]


def decode_file(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths) of :func:`encode_file`; raises ValueError where a chunk does not match its crc32."""
    magic, _, _, _, n_ids, n_chunks, n_docs = _HEAD.unpack_from(data)
    ids = read_range(data, 0, n_ids if magic == _MAGIC else 0)
    frames = sum(_CHUNK.unpack_from(data, _HEAD.size + k * _CHUNK.size)[4] for k in range(n_chunks))
    return ids, np.frombuffer(data, "<u8", n_docs, _HEAD.size + n_chunks * _CHUNK.size + 4 * frames)


def write_ids(docs: DataFrame, scratch: Scratch, *, vocabulary: str, end_id: int, bits: bool = False, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode ``text`` of ``docs(doc_id, text)`` and write the files in ascending ``doc_id`` order.

    Returns the written table ``(shard, file_no, n_ids, n_docs, doc_ids, data)``: ascending shard,
    then file_no, is ascending doc_id. A null text is empty; it still gets the end id. Null
    doc_ids come first, rows of one doc_id are ordered by their text. Other columns are not read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of = byte_bpe(vocabulary, KEEP)
        end = np.array([end_id], "<u4").tobytes()
        shard, file_no, held, names, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            lengths = np.array([len(x) // 4 for x in held], "<u8")
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int64()), "file_no": pa.array([file_no], pa.int64()),
                "n_ids": pa.array([len(ids)], pa.int64()), "n_docs": pa.array([len(held)], pa.int64()),
                "doc_ids": pa.array([names], pa.list_(pa.int64())), "data": pa.array([encode_file(ids, lengths, bits=bits)], pa.binary()),
            })

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append(ids_of(text.as_py()) + end)
                names.append(name)
                size += len(held[-1]) // 4
                if size >= file_ids:
                    yield flush()
                    file_no, held, names, size = file_no + 1, [], [], 0
        if held:
            yield flush()

    rows = docs.select("doc_id", "text")
    dealt = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return scratch.write(
        dealt.mapInArrow(encode, "shard long, file_no long, n_ids long, n_docs long, doc_ids array<bigint>, data binary"), "ids"
    )


def read_ids(files: DataFrame) -> DataFrame:
    """Per document of :func:`write_ids`: doc_id, start, n_tokens, ids_crc32, file (shard and number)."""
    sums = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one row for each task that wrote
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    own = Window.partitionBy("shard").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("shard", "file_no", F.coalesce(F.sum("n_ids").over(own), F.lit(0)).alias("in_shard"))
    starts = starts.join(sums.hint("merge"), "shard").select("shard", "file_no", (F.col("shard_start") + F.col("in_shard")).alias("file_start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, numbers, names = (batch.column(k).to_pylist() for k in range(3))
            for shard, number, doc_ids, data in zip(shards, numbers, names, batch.column(3), strict=True):
                ids, lengths = decode_file(data.as_py())
                ends = np.cumsum(lengths.astype(np.int64))
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([shard] * n, pa.int64()), "file_no": pa.array([number] * n, pa.int64()),
                    "doc_id": pa.array(doc_ids, pa.int64()), "in_file": pa.array(ends - lengths.astype(np.int64), pa.int64()),
                    "n_tokens": pa.array(lengths.astype(np.int64), pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                })

    read = files.select("shard", "file_no", "doc_ids", "data").mapInArrow(
        decode, "shard long, file_no long, doc_id long, in_file long, n_tokens long, ids_crc32 long"
    )
    # starts have a row for each file, so they are never broadcast
    return read.join(starts.hint("merge"), ["shard", "file_no"]).select(
        "doc_id", (F.col("file_start") + F.col("in_file")).alias("start"), "n_tokens", "ids_crc32",
        F.concat_ws("-", F.col("shard").cast("string"), F.col("file_no").cast("string")).alias("file"),
    )


def token_planes(spark: SparkSession, docs: DataFrame, *, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, bits: bool = False) -> DataFrame:
    """Write ``docs`` as plane files and read every document back from them.

    Empty table: no file, no row. Null or empty text: the end id alone. Repeated rows: each is kept.
    """
    small_batches(spark)
    return read_ids(write_ids(docs, Scratch(spark, "planes"), vocabulary=vocabulary, end_id=end_id, bits=bits))
