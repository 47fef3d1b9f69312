"""Token planes and packing: exact round trips, and every edge case of the inputs."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from factloom.llm.bitplane import decode_file, encode_file, read_range, token_planes
from factloom.llm.common import ByteBPE, byte_bpe
from factloom.llm.packing import pack, shortest_pack_first, slots_of

ROWS = [
    (5, "The end. Don't stop 12 times!", "x"), (3, None, "x"), (4, "", None), (1, "naïve café 漢字 ²½\u00a0x", "y"), (2, "<|endoftext|> a", "y"),
    (9, "word " * 3000, "z"), (9, "word " * 3000, "z"), (None, "no id", "z"), (7, "a\n\n  b\t\tc  ", "z"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash") for r in ROWS], "doc_id long, text string, start string, length string").repartition(3)


def reference(text):
    return [*byte_bpe("byte_bpe_50k.json").tokenizer.encode(text or "", add_special_tokens=False).ids]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 70_000])
def test_file_round_trip(bits, n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 2**32 if n == 7 else 50_257, n).astype("<u4")
    lengths = [n // 3, n - n // 3, 0]
    data = encode_file(ids, lengths, bits=bits, block_ids=4_096)
    got, sizes = decode_file(data)
    assert (got == ids).all() and list(sizes) == lengths
    if n == 70_000 and not bits:
        assert len(data) < ids.nbytes / 1.5
    if n:
        with pytest.raises(Exception):
            decode_file(data[:-3] + bytes(3) if n > 8 else b"no" + data)


@pytest.mark.parametrize("bits", [False, True])
def test_ranges_read_only_their_chunks(bits):
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 50_257, 10_000).astype("<u4")
    data = encode_file(ids, [4_000, 6_000], bits=bits, block_ids=1_000)
    for _ in range(50):
        a, b = sorted(rng.integers(0, 10_001, 2).tolist())
        assert (read_range(data, a, b) == ids[a:b]).all()
    assert len(read_range(data, 10_000, 10_000)) == 0
    with pytest.raises(IndexError):
        read_range(data, 5, 10_001)
    # damage in the last chunk is found where that chunk is read, and does no harm elsewhere
    hurt = data[:-3] + bytes([data[-3] ^ 255, data[-2] ^ 255, data[-1] ^ 255])
    assert (read_range(hurt, 0, 9_000) == ids[:9_000]).all()
    with pytest.raises(Exception):
        read_range(hurt, 0, 9_001)


def test_bit_planes_through_the_query(spark, docs):
    key = lambda df: sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in df.collect())
    assert key(token_planes(spark, docs, bits=True)) == key(token_planes(spark, docs))


def test_cached_pieces_equal_the_library():
    rnd, bpe = random.Random(1), ByteBPE("byte_bpe_50k.json")
    bpe.KEEP = 50  # so that the full cache is met, too
    letters = "ab é  \n\t'sS tTre1239.,!?ÀŸ²½ \u00a0\u3000漢<|endoftext|>\r\x0b_"
    for _ in range(1_500):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40)))
        assert list(np.frombuffer(bpe(text), "<u4")) == reference(text), repr(text)
    assert len(bpe.known) <= 100


def test_planes(spark, docs):
    got = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in token_planes(spark, docs).collect()}
    start, want = 0, {}
    for doc_id, text, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*reference(text), 2]
        want[doc_id, start] = (len(ids), crc(ids))
        start += len(ids)
    assert got == want
    assert token_planes(spark, docs.limit(0)).count() == 0


def check_packed(rows, docs, size=1024):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert 0 < r.length <= size
    want = Counter()
    for doc_id, text, _ in docs:
        ids = [*reference(text), 0]
        for a in range(0, len(ids), size):
            want[doc_id, a, len(ids[a : a + size]), crc(ids[a : a + size]), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    for seq in by_seq.values():
        end = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= size and all(r.sequence_tokens == end for r in seq)
    assert sorted(by_seq) == list(range(len(by_seq)))


def test_pack(spark, docs):
    check_packed(pack(spark, docs).collect(), ROWS)
    assert pack(spark, docs.limit(0)).count() == 0


def test_pack_whole_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = pack(spark, table).collect()
    check_packed(rows, [(r.doc_id, r.text, None) for r in table.collect()])
    assert sum(r.length for r in rows) / 1024 / (1 + max(r.sequence_id for r in rows)) > 0.97


def test_patterns_place_every_piece_once():
    rnd = random.Random(3)
    for _ in range(200):
        size = rnd.choice([8, 16, 1024])
        lengths = Counter(rnd.randint(1, size) if rnd.random() < 0.7 else rnd.randint(1, max(1, size // 8)) for _ in range(rnd.randint(0, 300)))
        patterns = shortest_pack_first(dict(lengths), size)
        assert all(sum(n * t for n, t in p) <= size for _, p in patterns)
        assert len(patterns) <= 2 * len(lengths) + 2
        packs, slots = defaultdict(list), slots_of(patterns)
        for n, count in lengths.items():
            for r in range(count):
                (hit,) = [s for s in slots if s[0] == n and s[1] <= r < s[2]]
                _, a, _, seq, offset, times = hit
                packs[seq + (r - a) // times].append((offset + (r - a) % times * n, n))
        for p in packs.values():
            end = 0
            for offset, n in sorted(p):
                assert offset == end
                end += n


def one_by_one(lengths, size):
    """Shortest-pack-first in its plain form: totals of the packs, each piece by itself, longest first."""
    packs = []
    for n in sorted(lengths.elements(), reverse=True):
        shortest = min(range(len(packs)), key=packs.__getitem__, default=None)
        if shortest is None or packs[shortest] + n > size:
            packs.append(n)
        else:
            packs[shortest] += n
    return sorted(packs)


def totals(patterns):
    return sorted(x for count, p in patterns for x in [sum(n * t for n, t in p)] * count)


def test_patterns_equal_packing_one_by_one():
    rnd = random.Random(8)
    for k in range(300):
        size = rnd.choice([5, 16, 100, 1024])
        top = rnd.choice([size, max(1, size // 2), max(1, size // 9)])
        lengths = Counter(rnd.randint(1, top) for _ in range(rnd.randint(0, 400))) + Counter({rnd.randint(1, size): rnd.randint(0, 60)})
        assert totals(shortest_pack_first(dict(lengths), size)) == one_by_one(lengths, size), k


@pytest.mark.parametrize(("lengths", "packs"), [({800: 1, 100: 2}, 1), ({600: 3, 200: 6}, 3), ({1: 1024}, 1), ({1024: 2, 1: 1}, 3), ({}, 0)])
def test_rooms_that_arise_are_used_again(lengths, packs):
    assert sum(count for count, _ in shortest_pack_first(lengths, 1024)) == packs


def test_histogram_does_not_depend_on_the_number_of_pieces():
    few = shortest_pack_first({700: 3, 300: 5, 24: 2}, 1024)
    many = shortest_pack_first({700: 3 * 10**9, 300: 5 * 10**9, 24: 2 * 10**9}, 1024)
    assert len(few) <= 8 and len(many) <= 8
