import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textsketch.llm import packing


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: np.array(t.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


EDGES = ["", " ", "\n", "a  b", "a   b", " a ", "a \n b", "a\n\n b  ", "x <|endoftext|> y", "a\t b  c    d", "<|endoftext|>", "a<|endoftext|><|endoftext|>  b", "<|endoftext|", " <|endoftext|>\n <|endoftext|>", "don't we'll  'tis", "é ñ  ¿que? 123 4\r\n 5", "a\x00b c\x00", "你好 世界", "a" * 5000, " \n", "a \n"]


def test_ids_equal_the_tokenizers_library(reference):
    for text in EDGES:
        assert packing.token_bytes(text) == reference(text), repr(text[:20])


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)]


def check(rows, texts, reference, capacity):
    by, whole = defaultdict(list), defaultdict(dict)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
        whole[r.doc_id][r.piece] = r
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    for doc_id, text in texts:
        ids, at = reference(text or "") + bytes(4), 0
        for k in range(len(whole[doc_id])):
            r = whole[doc_id][k]
            assert r.start == at and zlib.crc32(ids[4 * at : 4 * (at + r.length)]) == r.ids_crc32
            at += r.length
        assert at == len(ids) // 4
    return len(by)


def test_edge_cases_pack_whole(documents, reference):
    texts = [(k, t) for k, t in enumerate([*EDGES, None, "word " * 3000])]
    rows = packing.pack(documents(texts), capacity=64).collect()
    n = check(rows, texts, reference, 64)
    assert n <= sum(r.length for r in rows) // 64 + 3


def test_repeated_rows_empty_tables_and_ids(documents, spark):
    rows = packing.pack(documents([(1, "a b"), (1, "a b"), (None, "c")]), keep_ids=True).collect()
    assert sorted((r.doc_id or -1, r.length) for r in rows) == [(-1, 2), (1, 3), (1, 3)]
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows) and len({r.sequence_id for r in rows}) == 1
    assert packing.pack(documents([])).count() == 0


def test_evolution_beats_best_fit_on_triplets():
    rng = np.random.default_rng(2)
    lengths = []
    for _ in range(40):  # triplets that fill a bin exactly
        a = int(rng.integers(380, 490))
        b = int(rng.integers(250, (1000 - a) // 2))
        lengths += [a, b, 1000 - a - b]
    start = packing.best_fit(lengths, 1000)
    found = packing.evolve(lengths, 1000, [], 1, generations=150)
    assert len(found) <= len(start) and len(found) <= 42
    assert sorted(i for b in found for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 1000 for b in found)


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 2048, 200).tolist()
    a, b = packing.best_fit(lengths, 2048), packing.evolve(lengths, 2048, [], 5, generations=3)
    for child in (packing.crossover(a, b, lengths, 2048, rng), packing.mutate(a, lengths, 2048, rng)):
        assert sorted(i for x in child for i in x) == list(range(200))
        assert all(sum(lengths[i] for i in x) <= 2048 for x in child)


def test_islands_migrate_and_improve(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    lengths = [int(x) for x in rng.integers(300, 700, 300)]
    bins = packing.best_fit(lengths, 1000)
    row = [("s", lengths, packing._numbers(bins, 300), 9)]
    shards = spark.createDataFrame(row, "shard string, length array<bigint>, bin array<int>, over int")
    found = packing._evolved(shards, 1000, 3, 2).first()
    got = packing._bins(found.found)
    assert len(got) <= len(bins) and all(sum(lengths[i] for i in b) <= 1000 for b in got)
    assert sorted(i for b in got for i in b) == list(range(300))
    assert packing._evolved(shards.where(F.lit(False)), 1000, 3, 2).count() == 0


def test_documents_near_the_lower_bound(spark, small, reference):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = packing.pack(docs).collect()
    n = check(rows, [(r.doc_id, r.text) for r in docs.collect()], reference, 2048)
    assert n <= -(-sum(r.length for r in rows) // 2048) + 1


def test_random_texts_have_the_ids_of_the_library(reference):
    rng = np.random.default_rng(8)
    parts = ["<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "a", "Bc", "é", "1", "'s", "\t", ".", "的"]
    for _ in range(3000):
        text = "".join(parts[k] for k in rng.integers(0, len(parts), rng.integers(0, 12)))
        assert packing.token_bytes(text) == reference(text), repr(text)


def test_sequence_ids_are_injective():
    """The largest numbers of each part fit beside one another; more is refused."""
    top = packing._number(1, (1 << 21) - 1, (1 << 28) - 1)
    assert (top << 12 | 4095) == (1 << 62) - 1 and packing.SHARD <= 1 << 12
    assert packing._number(0, 1, 0) != packing._number(0, 0, 1) != packing._number(1, 0, 0)
    with pytest.raises(ValueError):
        packing._number(0, 1 << 21, 0)
