import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textsketch.llm import simhash


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps):
    n = len(fps)
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


TEXTS = [None, "", " \n\t", "One", "one", "ONE two", "one two three", "One Two THREE four", "Éa éa", "a b c d", "a\x0bb\x0cc d e f g", "x " * 300]


def test_fingerprints():
    for t in TEXTS:
        assert simhash.fingerprint(t) == brute_fingerprint(t), t


def test_edge_cases(documents):
    rows = [(10 + k, t) for k, t in enumerate(TEXTS)] + [(3, "one"), (3, "one"), (None, "one"), (None, "lonely unique words here")]
    got = simhash.near_duplicates(documents(rows)).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    assert by[10, "0" * 16] == by[12, "0" * 16] == 10
    one = f"{brute_fingerprint('one'):016x}"
    assert by[13, one] == by[14, one] == by[3, one] == by[None, one] == 3
    assert by[None, f"{brute_fingerprint('lonely unique words here'):016x}"] is None
    assert simhash.near_duplicates(documents([])).count() == 0
    kept = simhash.keep_one(documents(rows))
    assert kept.columns == documents([]).columns
    assert len([r for r in kept.collect() if r.text == "one"]) == 1 and kept.where("text = 'lonely unique words here'").count() == 1


@pytest.mark.parametrize("paired", [32, 2])
def test_links_connect_what_brute_force_connects(spark, paired):
    """paired=2 sends almost every pair the way of crowded keys."""
    rng = np.random.default_rng(8)
    fps = {0, (1 << 64) - 1, 1, 3, 7}
    for _ in range(40):
        x = int(rng.integers(0, 1 << 63)) * 2 + 1
        fps.add(x)
        for _ in range(12):
            fps.add(x ^ sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(1, 5))}))
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    links = simhash.links(df, paired).collect()
    at = {x: k for k, x in enumerate(signed)}
    label = list(range(len(fps)))
    for r in links:
        assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2
        a, b = label[at[r.a]], label[at[r.b]]
        label = [min(a, b) if x in (a, b) else x for x in label]
    assert label == brute(fps)


def test_components_of_long_chains(spark):
    from textsketch.llm.common import connected_components

    n = 200
    edges = spark.range(n - 1).select(F.expr("(id * 77) % 200").alias("a"), F.expr("((id + 1) * 77) % 200").alias("b"))
    got = connected_components(edges.union(edges)).collect()
    assert len(got) == n and {r.component for r in got} == {0}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    assert connected_components(spark.createDataFrame([(5, 5)], "a bigint, b bigint")).count() == 0


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    label = brute(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {r.doc_id: (f"{f:016x}", rows[x].doc_id) for r, f, x in zip(rows, fps, label, strict=True)}
