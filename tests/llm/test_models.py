"""Quality, language and language-model scores: held-out results and defined edge cases."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textsketch.llm import hmm, langid, quality
from textsketch.llm import queries as registry

MIDDLE = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    rows = [r for r in registry.op7_quality(spark, MIDDLE).collect() if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_quality_edges(spark, documents):
    docs = documents([(1, None), (2, ""), (3, "x" * 100_000), (3, "x" * 100_000), (None, "a b")])
    model = quality.fit([("good words of a good text " * 9, 1)] * 8 + [("!!! $$$ &&& " * 30, 0)] * 8)
    got = quality.score(docs, model)
    assert got.columns == [*(c for c in docs.columns if c != "quality_score"), "quality_score"]
    rows = got.collect()
    assert len(rows) == 5 and rows[0].quality_score == rows[1].quality_score and all(0 <= r.quality_score <= 1 for r in rows)
    assert quality.score(documents([]), model).count() == 0
    for rows, want in (([], 1.0), ([("a", 1)], 1.0), ([("a", 0)], 0.0)):
        assert quality.fit(rows).scores(["b"])[0] == pytest.approx(want, abs=1e-3)
    rows = [(f"good words of a good text {k} " * 9, 1) for k in range(8)] + [(f"!!! $$$ &&& {k} " * 30, 0) for k in range(8)]
    rare, even = quality.fit(rows, 0.01).scores(["zq"]), quality.fit(rows, 0.5).scores(["zq"])
    assert rare[0] < even[0] and even[0] == pytest.approx(quality.fit(rows).scores(["zq"])[0])  # scores follow the share of label 1
    assert b"".join(quality.blocks(b"x" * 5000)) == b"x" * 5000 and quality.blocks(b"") == [b""]


def test_language_held_out(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in registry.op6_language(spark, MIDDLE).collect() if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows]) > 0.97


def test_language_edges(spark, documents):
    model = langid.fit([("the cat and the dog " * 20, "en"), ("le chat et la souris " * 20, "fr")])
    docs = documents([(1, None), (2, ""), (3, "123 !? \n"), (4, "the dog"), (5, "la souris " * 20_000), (None, "the dog"), (6, "的" * 9)])
    got = langid.identify(docs, model)
    rows = {r.doc_id: r for r in got.collect()}
    assert [rows[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and rows[1].lang_score == 0
    assert rows[4].lang_pred == rows[None].lang_pred == "en" and rows[5].lang_pred == "fr" and rows[5].lang_score > 0.5
    assert rows[6].lang_pred == "en" and rows[6].lang_cover < 0.25  # a tie of nothing
    assert langid.identify(documents([]), model).count() == 0
    assert langid.fit([]).predict("words") == ("und", 0.0, 0.0)


def test_a_filter_has_no_false_negatives():
    rng = np.random.default_rng(1)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 9)) for _ in range(70)]  # more languages than bits in a mask
    texts = [(f"{w} " * 5, f"l{k:03d}") for k, w in enumerate(words)]
    model = langid.fit(texts)
    for t, lang in texts[::9]:
        assert model.predict(t)[0] == lang
        l = model.languages.index(lang)
        mask = model.masks[l // 64]
        for h in langid.ngrams(t)[1:]:
            at = langid.slots(h)
            keys, n = np.unique(h, return_counts=True)
            held = mask[at[0]] & mask[at[1]] & mask[at[2]]
            assert (held[np.isin(h, keys[n >= langid.LEAST])] & np.uint64(1 << (l % 64))).all()


def _brute_forward(states, x):
    p = np.zeros(hmm.STATES)
    total = 0.0
    for paths in np.ndindex(*[hmm.STATES] * len(x)):
        q = states.first[paths[0]] * states.emits[x[0], paths[0]]
        for a, b, c in zip(paths, paths[1:], x[1:]):  # noqa: B905
            q *= states.moves[a, b] * states.emits[c, b]
        total += q
    del p
    return math.log10(total)


def test_forward_and_baum_welch(monkeypatch):
    monkeypatch.setattr(hmm, "STATES", 3)
    rng = np.random.default_rng(0)
    states = hmm.States.begin(5, rng)
    texts = [rng.integers(0, 5, n).astype(np.int32) for n in (1, 4, 6, 2, 40)]
    for x, got in zip(texts[:4], states.loglik(texts)[:4], strict=True):
        assert got == pytest.approx(_brute_forward(states, x))
    first, moves, emits, (logs, n) = states.expected([hmm.Part(x, 0, len(x)) for x in texts])
    assert logs == pytest.approx(states.loglik(texts).sum()) and n == 53
    assert first.sum() == pytest.approx(5) and emits.sum() == pytest.approx(53) and moves.sum() == pytest.approx(48)
    before = states.loglik(texts).sum()
    raw = hmm.States(first / first.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))
    assert raw.loglik(texts).sum() > before  # expectation-maximisation never falls


def test_scores(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r for r in registry.op2_hmm(spark, small).collect()}
    texts = {r.doc_id: [*(r.text or "").encode().lower().split(), b"\n"] for r in docs.collect()}
    fold = {k: zlib.crc32(str(k).encode()) % 5 for k in texts}
    counts = Counter(t for k, x in texts.items() if fold[k] != 1 for t in x)
    n, v = sum(counts.values()), len(counts)
    for k, x in texts.items():
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in x)
        assert rows[k].base_score == pytest.approx(base) and rows[k].n_tokens == len(x)
        assert rows[k].n_known == sum(t in counts for t in x) and rows[k].train_tokens == n and rows[k].held_out == (fold[k] == 1)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_are_a_distribution():
    """Of a class, the shares of its tokens and of one unknown token sum to one."""
    counts = Counter({b"w%d" % k: 1 + k % 7 for k in range(4000)})
    counts[hmm.END] = 50
    rows = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    kinds: dict = {}
    for t, c in rows:
        a, b = kinds.get(hmm.shared_class(t), (0, 0))
        kinds[hmm.shared_class(t)] = a + c, b + 1
    head = hmm.Head(rows, sum(counts.values()), len(counts), kinds)
    share = Counter()
    for k in head.known.values():
        c = int(head.kind[k])
        share[c] += 10.0 ** head.share[k] if c < hmm.SHARED else 1.0
    for c in range(hmm.SHARED):
        assert share[c] + 10 ** (math.log10(0.5) - head.size[c]) == pytest.approx(1)


def test_score_edges(spark, documents):
    docs = documents([(1, None), (2, ""), (3, "A b"), (3, "A b"), (None, "zz " * 5000)])
    got = hmm.score(docs, F.lit(False)).collect()
    assert len(got) == 5 and {r.doc_id: r.n_tokens for r in got} == {1: 1, 2: 1, 3: 3, None: 5001}
    assert hmm.score(documents([]), F.lit(False)).count() == 0
    none = hmm.score(docs, F.lit(True)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in none)


def test_parts_of_a_text_have_its_counts(monkeypatch):
    """What is counted of a long text in parts is what is counted of it whole: its one first state, all transitions and tokens."""
    monkeypatch.setattr(hmm, "STATES", 3)
    rng = np.random.default_rng(2)
    states = hmm.States.begin(9, rng)
    text = rng.integers(0, 9, 700).astype(np.int32)
    whole = states.expected([hmm.Part(text, 0, len(text))])
    monkeypatch.setattr(hmm, "SEGMENT", 64)
    parts = hmm.segments(text)
    assert sum(p.stop - p.own for p in parts) == 700 and np.concatenate([p.classes[p.own : p.stop] for p in parts]).tolist() == text.tolist()
    got = states.expected(parts)
    assert got[0].sum() == pytest.approx(1) and got[1].sum() == pytest.approx(699) and got[2].sum() == pytest.approx(700)
    for a, b in zip(got, whole, strict=True):
        assert np.abs(a - b).max() < 0.02 * max(1, np.abs(b).max())


def test_passes_raise_the_likelihood(spark, small):
    texts = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.lit(False).alias("held_out"), "text")
    *_, history = hmm.train(texts)
    assert 2 <= len(history) <= hmm.PASSES and history == sorted(history)


def _slow_language(model, text):
    """Languages of each n-gram one by one."""
    word = lambda c: c.isalpha()
    out, last = [" "], False
    for c in (text.lower() if text else "") + " ":
        if word(c) or last:
            out.append(c if word(c) else " ")
        last = word(c)
    total, hits = 0, Counter()
    for n in langid.SIZES:
        for k in range(len(out) - n + 1):
            h = n
            for i, c in enumerate(out[k : k + n]):
                h = (h ^ ord(c)) * int(langid._MIX[i]) % 2**64
                h ^= h >> 29
            h = h * int(langid._MIX[0]) % 2**64
            at = [((h >> 40) + j * (h >> 16 & 0xFFFFFF | 1)) % langid.SLOTS for j in range(langid.HASHES)]
            total += 1
            for i, language in enumerate(model.languages):
                hits[language] += all(int(model.masks[i // 64][a]) >> (i % 64) & 1 for a in at)
    if not any(map(word, text or "")):
        return "und", 0.0
    counts = [max(0, hits[x] - total * w) / (1 - w) for x, w in zip(model.languages, model.wrong, strict=True)]
    best = max(range(len(counts)), key=lambda k: (counts[k], -k))
    return model.languages[best], counts[best] / max(sum(counts), 1e-9)


def test_languages_by_brute_force(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    model = langid.train(docs)
    rows = [r.text for r in docs.where("length(text) < 1500").orderBy("doc_id").limit(60).collect()]
    for text in [*rows, "", None, "12 !", "A-b ÉÀ x", "Straße\n\n eins"]:
        language, score, _ = model.predict(text)
        want = _slow_language(model, text)
        assert language == want[0] and score == pytest.approx(want[1], abs=1e-9)


def test_no_ngram_is_lost_between_parts(monkeypatch):
    text = "El ñandú, 12 -- corrió!  l'été (a) b\n" * 40
    want = np.sort(np.concatenate(langid.ngrams(text)))
    for part in (1, 2, 3, 5, 64, len(text), len(text) + 1):
        monkeypatch.setattr(langid, "_PART", part)
        assert np.array_equal(np.sort(np.concatenate(list(langid.parts(text)))), want), part


def test_quality_by_brute_force(spark):
    """Sizes from a compressor of its own for each block, and the calibration written out."""
    import zstandard

    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    for r in docs.orderBy("doc_id").limit(40).collect():
        z = 0.0
        for half in model.halves:
            x = []
            for (good, bad), view in zip(half.dictionaries, quality._views(r.text), strict=True):
                sizes = []
                for d in (good, bad):
                    c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
                    sizes.append(sum(len(c.compress(b)) for b in quality.blocks(view)))
                x += [(sizes[1] - sizes[0]) / sum(sizes), (sizes[1] - sizes[0]) / (len(view) + 8)]
            z += sum(w * (v - m) / s for w, v, m, s in zip(half.weights, x, half.mean, half.spread)) + half.weights[-1]  # noqa: B905
        assert model.scores([r.text])[0] == pytest.approx(1 / (1 + math.exp(-z / 2)), abs=0.02)


def test_samples_are_bounded(spark):
    """However often an id or a row is repeated, and whatever labels say of it."""
    from textsketch.llm.common import collected, sampled

    hot = spark.range(5000).select(F.lit(145).alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"))
    own = spark.range(50).select((F.col("id") + 1000).alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("en").alias("lang"))
    many = spark.range(3000).select(F.lit(7).cast("bigint").alias("doc_id"), F.concat(F.lit("u"), "id").alias("text"), F.lit("fr").alias("lang"))
    got = collected(hot.union(own).union(many), "lang", 60, "s", ["doc_id", "text"])
    by = Counter(r.lang for r in got)
    assert 45 <= by["en"] <= 51 and 30 <= by["fr"] <= 60
    assert len(set(got)) == len(got) and len({r.doc_id for r in got if r.lang == "en"}) > 45
    assert sampled(hot.union(own).union(many), "lang", 60, "s", ["doc_id", "text"]).count() <= 51 + 100
    assert sampled(hot.limit(0), "lang", 60, "s", ["doc_id", "text"]).count() == 0
    labels = spark.createDataFrame([(145, 1), (145, 0), (7, 1), (7, 1), *((1000 + k, k % 2) for k in range(50))], "doc_id bigint, quality int")
    seen = []
    keep = quality.fit
    try:
        quality.fit = lambda rows, share: seen.extend(rows) or keep(rows, share)
        quality.train(hot.union(own).union(many), labels, most=40)
    finally:
        quality.fit = keep
    assert Counter(q for _, q in seen).most_common(1)[0][1] <= 40 and not any(t == "same" for t, _ in seen)
