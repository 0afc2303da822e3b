"""Golden values, brute force and properties of the kernels, without Spark."""

import random
from collections import Counter
from itertools import islice

import pytest

from textsketch.functions import fold
from textsketch.functions.bigram_table import priority
from textsketch.functions.fold_table import FROM, TO
from textsketch.functions.hashing import SipHash13, splitmix64
from textsketch.operators import bpe, geo, ngrams, placement
from textsketch.operators.placement import ChooseK, NodeMap, Reservoir, Source


def test_fold_table():
    assert len(FROM) == len(TO) == 1484
    assert fold.fold_text("Hello, WORLD! ÜBER Größe ȺẞÉ") == "hello, world! über größe ⱥßé"
    assert fold.fold_text("Kelvin") == "kelvin"
    assert fold.fold_char("ﬅ") == "ﬆ"
    for c, want in (("Ü", 0xFC), ("中", 0xAD), ("K", 0xEB), ("Ⱥ", 0xE5), ("A", 0x61)):
        assert fold.index_fold_char(c) == want
    assert fold.fold_text(fold.fold_text(FROM)) == fold.fold_text(FROM)


def _estimate(config, buckets):
    own = sorted(buckets, reverse=True)
    top = own[config.msb - 1] if len(own) >= config.msb else 0
    block = max(0, (top + 63) // 64 - config.blocks)
    total = sum(1 for k, x in enumerate(own) if k < config.msb or x >= block * 64)
    lowest = 0 if total <= config.msb else block * 64
    est = geo.expected_items(config, total)
    return (est + 1) / config.phi32**lowest - 1 if lowest else est


@pytest.mark.parametrize(
    ("n", "diff", "distinct"), [(10, 10.0042095, 10.0021105), (100, 100.422966, 100.21153), (1000, 1002.95654, 1001.81635), (10_000, 9876.323, 9951.017), (30_000, 29577.656, 29927.705)]
)
def test_sketch_goldens(n, diff, distinct):
    hits = Counter(geo.hash_to_bucket(SipHash13().i32(i).finish(), 13) for i in range(n))
    assert _estimate(geo.DIFF13, [b for b, k in hits.items() if k % 2]) == pytest.approx(diff, rel=3e-7)
    assert _estimate(geo.DISTINCT13, list(hits)) == pytest.approx(distinct, rel=3e-7)


def test_bucket_ends():
    for b in (7, 10, 13):
        assert geo.hash_to_bucket((1 << 64) - 1, b) == 0
        assert geo.hash_to_bucket(0, b) == (65 << b) - 1


def test_sketch_bytes_round_trip():
    rng = random.Random(3)
    for config in (geo.DIFF7, geo.DIFF10, geo.DIFF13):
        for n in (0, 1, config.msb, 500):
            own = rng.sample(range(3000), n)
            assert sorted(geo.unpack(geo.pack(own, config), config)) == sorted(own)


def test_ones_metric():
    for n in (1, 5, 50, 400):
        assert geo.items_to_ones(geo.DIFF7, geo.ones_to_items(geo.DIFF7, n)) == n
    assert geo.ones_to_items(geo.DIFF7, None) == float("inf")
    assert geo.items_to_ones(geo.DIFF7, float("nan")) is None
    assert geo.items_to_ones(geo.DIFF7, -3.0) == 0
    assert geo.ones_add(geo.DIFF7, 65_000, 65_000) is None


def test_sim_hashes_of_alike_sketches_agree():
    a = [geo.hash_to_bucket(splitmix64(k), 7) for k in range(1000)]
    odd = [b for b, k in Counter(a).items() if k % 2]
    assert geo.sim_hashes(odd) == geo.sim_hashes(odd[::-1])
    hashes, least = geo.sim_search(odd, 5, geo.DIFF7)
    assert least >= 10 and len(set(hashes) & set(geo.sim_indexing(odd))) >= least


def test_choose_k_goldens():
    at = Counter((i, x) for k in range(32783, 32815) for x in ChooseK.with_k(Source.of(k), 8, 2).samples for i in [0])
    assert " ".join(str(at[0, i]) for i in range(8)) == "10 12 6 6 6 5 9 10"
    prev = Counter(placement.prev_hash(Source.of(k), 13) for k in range(100_000))
    assert [prev[i] for i in range(4)] == [7577, 7541, 7538, 7822]


def test_choose_k_is_consistent():
    for source in (Source, placement.MixSource):
        for key in range(30):
            for n in range(2, 16):
                grown = ChooseK(source.of(key), n)
                ranked = list(islice(grown, n))
                assert sorted(ranked) == list(range(n))
                for k in range(1, n):
                    own = ChooseK.with_k(source.of(key), n, k)
                    assert sorted(ranked[:k]) == own.samples
                    assert len(set(own.samples) - set(ChooseK.with_k(source.of(key), n + 1, k).samples)) <= 1
                    if own.samples[-1] < k:
                        continue
                    own.shrink_n()
                    assert own.samples == ChooseK.with_k(source.of(key), own.n, k).samples
    with pytest.raises(ValueError, match="at least"):
        ChooseK.with_k(Source.of(1), 2, 3)


def test_hashes_up_and_down_agree():
    for key in range(100):
        down = list(placement.hashes_below(Source.of(key), 1000))
        assert down[-1] == 0 and down == sorted(down, reverse=True)
        up = [x for x in islice(placement.hashes_from(Source.of(key), 0), 40) if x < 1000]
        assert up == down[::-1]
        # one below a power of two, the level that it is in is passed over
        assert all(placement.next_hash(Source.of(key), x) == x for x in down if x == 0 or x & (x + 1))


def test_node_map():
    nodes = NodeMap()
    assert nodes.is_empty() and nodes.get(Source.of(1)) is None
    assert [nodes.add() for _ in range(5)] == [0, 1, 2, 3, 4]
    before = {k: nodes.get(Source.of(k)) for k in range(300)}
    assert nodes.remove(2) and not nodes.remove(2) and not nodes.remove(9)
    after = {k: nodes.get(Source.of(k)) for k in range(300)}
    assert all(after[k] == n for k, n in before.items() if n != 2) and 2 not in after.values()
    assert len(nodes) == 4 and nodes.slot_count() == 5 and not nodes.is_active(2)
    assert nodes.add() == 2 and nodes.remove(4) and nodes.slot_count() == 4


@pytest.mark.parametrize("n", [*range(1, 6), *range(7, 10), 16, 17, *range(31, 34), 100, 1000])
def test_permutation_is_a_bijection(n):
    for seed in range(4):
        assert sorted(placement.permutation(n, splitmix64(seed))) == list(range(n))


@pytest.mark.parametrize("k", [1, 2, 3, 10, 100])
def test_reservoir_is_the_head_of_the_permutation(k):
    for seed in (42, 123456789):
        key = splitmix64(seed)
        of = Reservoir(k, k, key)
        for _ in zip(range(100), of):  # noqa: B905
            assert of.reservoir() == list(islice(placement.permutation(of.n, key), k))


def test_sparse_grams_by_brute_force():
    for t in (b"", b"a", b"ab", b"hello world", b"aaaaaaaaaa", b"the the the the", b"self.reset_states(the_quick_brown_fox_jumps", bytes(range(200)), bytes(k % 256 for k in range(1000))):
        p, want = [priority(a, b) for a, b in zip(t, t[1:])], []  # noqa: B905
        for end in range(2, len(t) + 1):
            for n in range(2, min(8, end) + 1):
                s = end - n
                if n == 2 or max(p[s], p[end - 2]) < min(p[s + 1 : end - 2], default=1 << 40):
                    want.append((end, n))
        ends, sizes = ngrams.sparse_spans(t)
        assert list(zip(ends.tolist(), sizes.tolist(), strict=True)) == want
        keys, _ = ngrams.sparse_grams(t)
        assert keys.tolist() == [ngrams.gram_key(t[e - n : e]) for e, n in want]
        assert len(keys) <= ngrams.max_sparse_grams(len(t))
        assert [ngrams.gram_length(k) for k in keys.tolist()] == [n for _, n in want]


def test_query_grams():
    state, seen = ngrams.QueryGrams(), []
    for c in "hello world":
        state.append_char(c, lambda *_: None)
        seen.append(state.state()[0])
    assert "".join(map(str, seen)) == "12323232345"
    rng = random.Random(5)
    for _ in range(500):
        q = "".join(rng.choice("abcdefgh lardeesk") for _ in range(rng.randint(1, 16)))
        cover, data = ngrams.cover(q), fold.index_fold_bytes(q)
        assert len(cover) == ngrams.least_cover_size(q)
        assert all(data[e - len(g) : e] == g for g, e in cover)
        held = set(ngrams.collect_sparse_grams(fold.index_fold_bytes("xy " + q + "zw")))
        assert {ngrams.gram_key(g) for g, _ in cover} <= held


def test_consume_first_ends_as_new():
    state = ngrams.QueryGrams()
    for c in "hello world":
        state.append_char(c, lambda *_: None)
    for _ in range(20):
        state.consume_first(lambda *_: None)
    assert state == ngrams.QueryGrams() and state.min_priority() == (1 << 32) - 1


TOY = [b"a", b"b", b"c", b"ab", b"cb", b"ac", b"bb", b"cbb", b"acbb"]


def test_bpe_toy():
    v = bpe.Vocabulary(TOY)
    for f in (v.encode, v.encode_via_backtracking, v.encode_via_table):
        assert [v.tokens[t] for t in f(b"abacbb")] == [b"ab", b"acbb"]
    assert v.count_till_limit(b"abacbb", 2) == 2 and v.count_till_limit(b"abacbb", 1) is None
    assert v.encode(b"") == v.encode_greedy(b"") == v.encode_minimal(b"") == []
    with pytest.raises(ValueError, match="twice"):
        bpe.Vocabulary([b"a", b"a"])


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_bpe_encoders_agree(vocabulary):
    v = vocabulary
    assert all(v.encode(t) == [i] for i, t in list(enumerate(v.tokens))[::97])
    for seed in range(4):
        data = bpe.create_test_bytes(v, 300, seed)
        tokens = v.encode(data)
        assert v.decode(tokens) == data
        assert tokens == v.encode_via_backtracking(data) == v.encode_via_table(data)
        a, p, of, rng = bpe.Appendable(v), bpe.Prependable(v), bpe.Intervals(v, data), random.Random(seed)
        a.extend(data)
        p.extend(data)
        assert a.token_count() == p.token_count() == len(tokens) and len(a) == len(p) == len(data)
        a.truncate(100)
        assert a.token_count() == v.count(data[:100])
        for _ in range(40):
            s, e = sorted((rng.randrange(len(data) + 1), rng.randrange(len(data) + 1)))
            assert of.count(s, e) == v.count(data[s:e])
        assert len(v.encode_minimal(data)) <= len(tokens)
        assert len(v.encode_minimal(data, 1.0, 1)) == len(data)


def test_tokenizer_equals_a_third_party(vocabulary):
    import public_tokenizers
    import tiktoken

    own = bpe.Tokenizer(vocabulary, public_tokenizers.PATTERN)
    ranks = {t: i for i, t in enumerate(vocabulary.tokens)}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("Hello world, don't you  see 123 é\n\n x", "", "   ", "ab " * 50, "naïve Größe ¿qué? 你好 \t\n"):
        assert own.encode(text) == other.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text and own.count(text) == len(own.encode(text))
        for limit in (1, 3, 64):
            chunks = list(own.chunks(text, limit))
            assert "".join(text[s:e] for s, e, _ in chunks) == text
    assert bpe.Tokenizer(vocabulary, nfc=True).normalize("é") == "é"
    assert own.decode([vocabulary.ids[b"\xc3"]]) is None
    for pattern in bpe.PATTERNS.values():
        t = bpe.Tokenizer(vocabulary, pattern)
        assert "".join(t.split("Hello WORLD's 12345 -- ok\r\n\n  end ")) == "Hello WORLD's 12345 -- ok\r\n\n  end "


def test_choices_of_many_keys_are_those_of_each():
    import numpy as np

    from textsketch.operators import placement

    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(1000, 1060)]
    own = np.array(keys, dtype=np.int64).view(np.uint64)
    for source, many in placement._MANY.items():
        for n, k in ((1, 1), (2, 2), (8, 2), (20, 20), (100, 3), (100_000, 4)):
            assert placement._Chosen(many.of(own), len(own), n, k).ranking().tolist() == [list(islice(ChooseK(source.of(x), n), k)) for x in keys]
            assert placement._Chosen(many.of(own), len(own), n, k).chosen().tolist() == [ChooseK.with_k(source.of(x), n, k).samples for x in keys]


def test_pieces_are_those_of_split():
    import public_tokenizers

    from textsketch.operators import bpe

    v = bpe.Vocabulary([bytes([b]) for b in range(256)])
    for pattern in (public_tokenizers.PATTERN, r"\w+| ", "(a)|b", "a*"):
        own = bpe.Tokenizer(v, pattern)
        for text in ("", "it's  a\n\n test 12ß ", "ab!ab", "aab", "  x"):
            assert list(own.pieces(text)) == list(own.split(text))


def test_stretches_hold_all_rows_in_order(monkeypatch):
    import pyarrow as pa

    from textsketch.functions import shared

    monkeypatch.setattr(shared, "STRETCH", 100)
    texts = ["x" * n for n in (0, 3, 250, 40, 40, 40, 90, 100, 1)] + [None]
    batch = pa.RecordBatch.from_pydict({"k": list(range(len(texts))), "t": pa.array(texts, pa.string())})
    parts = list(shared.stretches(batch))
    assert [r for p in parts for r in p.to_pylist()] == batch.to_pylist() and len(parts) > 4
    assert list(shared.stretches(batch.slice(0, 0))) == []


def test_grams_of_many_texts_are_those_of_each():
    from textsketch.operators import ngrams

    texts = [b"", b"a", b"hello world", bytes(range(200)), b"aaaaaaaaaa", b"", b"self.reset_states(the_quick_brown_fox_jumps", b"xy"]
    of, keys, ends = ngrams._grams_of(texts)
    got = sorted(zip(of.tolist(), ends.tolist(), keys.tolist(), strict=True))
    want = []
    for k, text in enumerate(texts):
        e, n = ngrams.sparse_spans(text)
        want += [(k, int(b), ngrams.gram_key(text[b - s : b])) for b, s in zip(e.tolist(), n.tolist(), strict=True)]
    assert got == sorted(want)
