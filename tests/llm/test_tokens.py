import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.llm import cases
from tickersieve.llm import frames, huffman, packing, shards, tokens
from tickersieve.llm.queries import vocabulary

NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")
BITS = ["a", "The", "é", " ", "  ", "\n", "\t", "1", "42", ".", "!?", "ß", "_", "'s", "don't", "—", "日本", "ñ", "Ğ", "\r", "<|", "<|endoftext|>", " \n ", "²", "\xa0", "İ", "×", "\x0b", "é"]


def texts(seed, n):
    pick = random.Random(seed)
    return ["".join(pick.choices(BITS[:16] if k % 2 else BITS, k=pick.randrange(12))) for k in range(n)] + [None, ""]


@pytest.mark.parametrize("name", NAMES)
def test_ids_equal_the_library(name, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 300)
    coder = tokens.Encoder(vocabulary(name))
    given = texts(1, 1500)
    for k in range(0, len(given), 100):
        part = given[k : k + 100]
        ids, at = coder.encode(pa.array(part, pa.string()))
        wanted = coder.library.encode_batch([t or "" for t in part], add_special_tokens=False)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [e.ids for e in wanted]


@pytest.mark.parametrize("n,limit", [(1, 4), (2, 4), (16, 4), (300, 9), (300, 18)])
def test_huffman_round_trip(n, limit):
    pick = np.random.default_rng(n)
    counts = np.zeros(n + 5, np.int64)
    counts[pick.permutation(n + 5)[:n]] = 1 + (pick.pareto(0.3, n) * 3).clip(max=1e9).astype(np.int64)
    lengths = huffman.code_lengths(counts, limit)
    assert lengths.max() <= limit and (lengths > 0).sum() == n
    assert n == 1 or sum(2.0 ** -int(x) for x in lengths if x) == 1
    table, bits = huffman.decoding_table(lengths)
    for size in (0, 1, 127, 128, 129, 5000):
        ids = pick.choice(np.flatnonzero(counts), size).astype(np.uint32)
        stream, marks = huffman.encode(ids, lengths, huffman.codes(lengths))
        sizes = np.full(len(marks), huffman.MARK_EVERY)
        if size:
            sizes[-1] = size - huffman.MARK_EVERY * (len(marks) - 1)
        assert (huffman.decode(np.frombuffer(stream, np.uint8), marks.astype(np.int64), sizes, table, bits) == ids).all()
        # any later checkpoint is a start of its own
        assert size < 300 or (huffman.decode(np.frombuffer(stream, np.uint8), marks[2:].astype(np.int64), sizes[2:], table, bits) == ids[256:]).all()


def test_huffman_is_optimal_without_a_limit_that_binds():
    import heapq

    counts = np.array([5, 9, 12, 13, 16, 45, 0, 1])
    heap = sorted(int(c) for c in counts if c)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    assert int((counts * huffman.code_lengths(counts)).sum()) == cost


def rows():
    return [(7 * k % 101, t) for k, t in enumerate(texts(4, 90))] + [(300, "word " * 9000), (301, None)]


def coded(name, end):
    library = Tokenizer.from_file(vocabulary(name))
    return {i: library.encode(t or "", add_special_tokens=False).ids + [end] for i, t in rows()}


def test_shards_round_trip(spark, monkeypatch):
    monkeypatch.setattr(shards, "BLOCK_TOKENS", 64)
    folder = frames.new_path(spark, "test")
    shards.write(cases.docs(spark, rows()), vocabulary(NAMES[0]), 2, folder)
    wanted, start = coded(NAMES[0], 2), 0
    found = {r.doc_id: r for r in shards.read(spark, folder).collect()}
    crcs = {r.doc_id: r.ids_crc32 for r in shards.read_digests(spark, folder).collect()}
    assert set(found) == set(wanted)
    for i in sorted(wanted):
        raw = np.array(wanted[i], "<u4").tobytes()
        assert (found[i].start, found[i].n_tokens, bytes(found[i].ids), crcs[i]) == (start, len(wanted[i]), raw, zlib.crc32(raw))
        start += len(wanted[i])
    blocks = spark.read.parquet(f"{folder}/blocks").orderBy("bucket", "place").collect()
    ids = [np.frombuffer(b.doc_ids, "<i8").tolist() for b in blocks]
    assert sum(ids, []) == sorted(wanted) and len(blocks) > 3


@pytest.mark.parametrize("make,n", [(cases.awkward, 12), (cases.empty, 0)])
def test_awkward_rows_and_empty_tables(spark, make, n):
    folder = frames.new_path(spark, "test")
    shards.write(make(spark), vocabulary(NAMES[0]), 2, folder)
    out = shards.read_digests(spark, folder).collect()
    assert len(out) == n and sum(r.n_tokens for r in out) == max((r.start + r.n_tokens for r in out), default=0)
    packed = packing.packed_documents(make(spark), vocabulary(NAMES[1]))
    assert packed.select("doc_id").distinct().count() == (0 if not n else 10)
    assert {r.length for r in packed.where("doc_id = 1").collect()} == ({1} if n else set())


def test_packing(spark):
    found = packing.packed_documents(cases.docs(spark, rows()), vocabulary(NAMES[1]), 0, 32).collect()
    wanted = {(i, k // 32): (k, ids[k : k + 32]) for i, ids in coded(NAMES[1], 0).items() for k in range(0, len(ids), 32)}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in found} == {key: (k, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for key, (k, ids) in wanted.items()}
    held = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == held.get(r.sequence_id, 0)
        held[r.sequence_id] = r.offset + r.length
    assert max(held.values()) <= 32 and len(held) <= -(-sum(held.values()) // 32) + 1


@pytest.mark.parametrize("seed", range(6))
def test_search_reaches_what_best_fit_misses(seed):
    """Bins cut at random from full ones can be packed without waste."""
    pick = random.Random(seed)
    lengths, full = [], 60
    for _ in range(full):
        cuts = sorted(pick.sample(range(1, 1000), pick.randrange(1, 4)))
        lengths += [b - a for a, b in zip([0, *cuts], [*cuts, 1000])]
    plain = packing.Bins(lengths, 1000)
    plain.fill()
    bins = packing.pack_lengths(lengths, 1000)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 1000 for b in bins)
    assert full <= len(bins) <= min(len(plain.items), full + 2)


def test_an_exchange_empties_a_bin():
    # best fit leaves three bins; two suffice after an exchange
    assert len(packing.pack_lengths([6, 5, 5, 4], 10)) == 2
    assert len(packing.pack_lengths([], 10)) == 0 and packing.pack_lengths([9], 10) == [[0]]
