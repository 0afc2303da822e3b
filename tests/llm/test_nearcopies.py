import random

import corpus_pipeline
import pytest

from textsketch.llm import nearcopies, simhash


def _sets(text):
    words = text.lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def _brute(texts):
    """Links of the stage: similar sets of shingles, or fingerprints at most two bits apart."""
    sets, fps, label = [_sets(t) for t in texts], [simhash.fingerprint(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) or (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


@pytest.mark.parametrize("chunk", [512, 8])
def test_edited_copies_are_kept_once(spark, documents, monkeypatch, chunk):
    """chunk=8 deals a group of copies over blocks."""
    monkeypatch.setattr(nearcopies, "CHUNK", chunk)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for k in range(60):
        own = [word() for _ in range(rng.randint(60, 300))]
        texts.append(" ".join(own))
        for _ in range(30 if k == 0 else 2):
            edited = list(own)
            for at in rng.sample(range(len(own)), rng.randint(1, max(1, len(own) // 35))):
                edited[at] = word()
            texts.append(" ".join(edited))
    label = _brute(texts)
    kept = {r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, documents(list(enumerate(texts))), "").collect()}
    assert kept == set(label) and len(kept) < 100


def test_edges(spark, documents):
    rows = [(1, None), (2, ""), (3, " "), (5, "one"), (4, "One"), (4, "One"), (None, "one"), (None, "lonely unique words here"), (6, "x " * 30_000)]
    docs = documents(rows)
    left = nearcopies.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:9]) for r in left.collect()) == [(0, "lonely un"), (1, ""), (4, "One"), (6, "x x x x x")]
    assert nearcopies.keep_one(documents([])).count() == 0
