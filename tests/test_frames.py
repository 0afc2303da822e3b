"""DataFrame operators: every registered query against its SQL on the smallest tables, and small fixtures."""

import duckdb
import pytest

from textsketch.functions import offsets
from textsketch.operators import geo, ngrams, placement, termmap
from textsketch.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(_plain, v)) if isinstance(v, list | tuple) else v


def compare(df, con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    assert sorted(names) == sorted(df.columns)
    got = sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)
    assert got == sorted((tuple(map(_plain, r)) for r in want), key=repr)


#: The larger half of the registry is compared by the driver; these take seconds.
QUICK = ["simple_fold", "index_fold", "offsets_lines", "offsets_probe", "merge_maps", "sort_by_hash", "sparse_grams", "substring_search", "bpe_chunks", "distinct_words_by_lang", "diff_symmetric_difference", "nearest_suppliers", "masked_order", "sketch_bytes", "bounded_load", "hash_ring", "users_by_day", "offsets_ranges", "offsets_sql", "distinct_union", "distinct_orders_finely", "diff_orders_finely", "bpe_ids", "bpe_count", "bpe_count_till_limit", "bpe_variants", "bpe_interval_counts", "sim_hash_postings", "gram_cover_sizes", "sparse_gram_spans_native", "ones_metric", "sketch_memory", "bounded_distances", "place_orders", "choose_goldens", "order_places", "reservoir_sample", "placement_churn", "placement_balance", "users_by_day_stream"]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, duck, name):
    compare(catalog.QUERIES[name](spark, SF), duck, catalog.ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stream_equals_batch(spark):
    batch = {(r.window_start, r.event_type): r.estimate for r in catalog.users_by_day(spark, SF).collect()}
    stream = catalog.users_by_day_stream(spark, SF).collect()
    assert {(r.window_start, r.event_type): r.estimate for r in stream} == batch


def test_offsets_of_emoji(spark):
    from pyspark.sql import functions as F

    text = "❤️ line0 ❤️Á 👋\n✅ line1\n"
    data = text.encode()
    df = spark.createDataFrame([(text, b) for b in range(len(data) + 3)], "t string, b int")
    t, b = F.col("t"), F.col("b")
    rows = df.select("b", offsets.utf8_to_char(t, b).alias("c"), offsets.utf8_to_line(t, b).alias("l"), offsets.utf8_to_utf16(t, b).alias("u"), offsets.lines(t).alias("n"), offsets.utf8s_to_lines(t, b, b).alias("r"), offsets.utf8_to_char_pos(t, b).alias("p")).collect()
    for r in rows:
        n = min(r.b, len(data))
        while 0 < n < len(data) and data[n] & 0xC0 == 0x80:
            n -= 1
        assert r.c == len(data[:n].decode())
        assert r.l == data[: r.b].count(10) if r.b < len(data) else r.l == 2
        if r.b >= len(data) or data[r.b] & 0xC0 != 0x80:
            assert r.u == len(data[:n].decode().encode("utf-16-le")) // 2
        assert r.n == 2 and r.r.start == r.l and r.r.end == min(2, r.l + 1) and r.p.line == r.l
    empty = spark.createDataFrame([("",)], "t string").select(offsets.lines(t).alias("n"), offsets.length(t).alias("b"), offsets.only_whitespaces(t, F.lit(5)).alias("w")).first()
    assert tuple(empty) == (0, 0, True)


def test_nulls_stay_null(spark):
    from pyspark.sql import functions as F

    from textsketch.functions import fold

    df = spark.createDataFrame([(None,)], "t string")
    row = df.select(fold.simple_fold(F.col("t")).alias("a"), fold.index_fold(F.col("t")).alias("b"), offsets.lines(F.col("t")).alias("c")).first()
    assert tuple(row) == (None, None, None)


def test_insert_twice_is_delete(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, None)], "k int, x string")
    assert geo.diff_sketch(df, ["k"], F.col("x")).count() == 1
    assert geo.distinct_sketch(df, ["k"], F.col("x")).count() == 2


def test_merge_of_sketches_is_sketch_of_union(spark):
    from pyspark.sql import functions as F

    df = spark.range(500).withColumn("g", F.lit(1))
    parts = [geo.distinct_sketch(df.where(c), ["g"], F.col("id")) for c in ("id < 300", "id > 200")]
    assert geo.union(*parts).exceptAll(geo.distinct_sketch(df, ["g"], F.col("id"))).isEmpty()


def test_map_operations(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", 1, 1), ("a", 5, 2), ("b", 3, 1), (None, 9, 9)], "k string, v int, at int")
    got = {r.key: (r.value, r.replaced) for r in termmap.insert(df, F.col("k"), F.col("v"), F.col("at")).collect()}
    assert got == {"a": (5, 1), "b": (3, 0)}
    m = termmap.upsert(df, F.col("k"), F.col("v"))
    assert {r.key: r.value for r in termmap.merge(m, m).collect()} == {"a": 12, "b": 6}
    order = [r.hash & (1 << 64) - 1 for r in termmap.sort_by_hash(m).collect()]
    assert order == sorted(order)
    assert termmap.size(m.where("false")).first().is_empty


def test_search_finds_folded(spark):
    docs = spark.createDataFrame([(1, "The QUICK brown fox"), (2, "nothing"), (3, None), (4, "")], "d bigint, text string")
    asked = spark.createDataFrame([(7, "quick BROWN"), (8, "zzz"), (9, "")], "q bigint, text string")
    assert [tuple(r) for r in ngrams.search(docs, asked, "d", "q").collect()] == [(7, 1)]


def test_sample_equals_permutation(spark):
    from itertools import islice

    got = {r["rank"]: r.id for r in placement.sample(spark.range(777), ["id"], 20, 5).collect()}
    assert [got[k] for k in range(20)] == list(islice(placement.permutation(777, 5), 20))
    assert placement.sample(spark.range(0), ["id"], 20, 5).count() == 0


def test_merged_maps_hold_words_of_all_languages(spark, tmp_path):
    from textsketch.plans import catalog

    docs = spark.createDataFrame([(1, "a b", "en"), (2, "a c", "it"), (3, "a d", None)], "doc_id bigint, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.key: r.value for r in catalog.merge_maps(spark, str(tmp_path)).collect()}
    assert got == {"a": 3, "b": 1, "c": 1, "d": 1}


@pytest.mark.parametrize("partitions", ["16", "4"])
def test_places_of_whole_rows(spark, partitions):
    """With all columns and many partitions: 0 to n-1, in order; through the public sample too."""
    orders = spark.read.parquet("/root/testdata/sf0.1/orders.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = placement._with_places(orders, ["o_orderkey"]).select("__place", "o_orderkey").toPandas().sort_values("o_orderkey")
        assert rows["__place"].tolist() == list(range(150_000))
        got = placement.sample(orders, ["o_orderkey"], 2000, 12345)
        assert got.columns == [*orders.columns, "rank"]
        keys = {r.o_orderkey for r in got.collect()}
        assert len(keys) == 2000 and keys == {r.o_orderkey for r in placement.sample(orders.select("o_orderkey"), ["o_orderkey"], 2000, 12345).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_places_of_one_value(spark):
    """A value that all rows share is spread, and every row has a place of its own."""
    same = spark.range(5000).selectExpr("1 AS k", "id")
    assert sorted(r["__place"] for r in placement._with_places(same, ["k"]).collect()) == list(range(5000))


def test_search_for_short_queries(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Abc É"), (2, "xyz"), (3, ""), (4, None)], "d int, text string")
    queries = spark.createDataFrame([(1, "a"), (2, "é"), (3, ""), (4, None), (5, "BC"), (6, "q")], "q int, text string")
    want = {(1, 1), (2, 1), (5, 1)}  # an empty query finds nothing
    assert {(r.q, r.d) for r in ngrams.search(docs, queries, "d", "q").collect()} == want
    monkeypatch.setattr(ngrams, "GRAMS", 0)
    assert {(r.q, r.d) for r in ngrams.search(docs, queries, "d", "q").collect()} == want


def test_blocks_of_sketches_find_the_same(spark, monkeypatch):
    rows = [(k, (k * 7 + j * j) % 50) for k in range(30) for j in range(1 + k % 9)]
    sketch = spark.createDataFrame(rows, "key bigint, bucket int").distinct()
    by = {}
    for k, b in set(rows):
        by.setdefault(k, set()).add(b)
    want = {(a, b): len(x ^ y) for a, x in by.items() for b, y in by.items() if x & y}
    monkeypatch.setattr(geo, "COMPARED", 7)
    assert {(r.a, r.b): r.distance for r in geo.distances(sketch, sketch).collect()} == want
    bound = {p: d if d < 5 else None for p, d in want.items() if abs(len(by[p[0]]) - len(by[p[1]])) < 5}
    assert {(r.a, r.b): r.distance for r in geo.distances(sketch, sketch, 5).collect()} == bound
    got = geo.nearest(sketch, sketch, 2, 4, geo.DIFF7).collect()
    short = {a: {b for _, b in sorted((d, b) for (x, b), d in want.items() if x == a and b != a)[:4]} for a in by}
    assert all(r.b in short[r.a] for r in got) and {(r.a, r["rank"]) for r in got} == {(a, k + 1) for a in by for k in range(min(2, len(short[a])))}


def test_comparators_of_samples(spark):
    for way in (placement.algorithm_r, placement.algorithm_l):
        assert all(len(set(way(5, n, s))) == min(5, n) and max(way(5, n, s)) < n for n in (1, 5, 6, 100) for s in range(20))
        counts = [0] * 20
        for s in range(4000):
            for x in way(4, 20, s):
                counts[x] += 1
        assert sum((c - 800) ** 2 / 800 for c in counts) < 60
    keys = spark.range(3000).withColumnRenamed("id", "key")
    rows = {r.test: r for r in placement.balance(placement.ranked(keys, "key", 10, 3), 10).collect()}
    assert rows["pair"].cells == 45 and rows["pair"].chi2 < 100 and rows["bit 0"].chi2 < 20 and {"node 0", "node 2", "bit 2"} <= set(rows)


def test_sim_lookup_is_the_definition(spark):
    """Short sketches that share most places with each other, copies, and longer ones; queries are a part of all."""
    import random

    rng = random.Random(4)
    own = {k: sorted(rng.sample(range(400), rng.choice([0, 1, 2, 3, 12, 40]))) for k in range(120)}
    own |= {k + 200: own[k][:] for k in range(60)} | {k + 300: own[k][1:] for k in range(60)}
    own = {k: v for k, v in own.items() if v}
    sketch = spark.createDataFrame([(k, x) for k, v in own.items() for x in v], "key bigint, bucket int")
    for expected in (5, 300):
        want = {}
        for a, v in own.items():
            hashes, least = geo.sim_search(v, expected, geo.DIFF7)
            for b, w in own.items():
                n = len(set(hashes) & set(geo.sim_indexing(w)))
                if a % 10 == 0 and a != b and n >= least:
                    want[a, b] = n
        lists = geo.listed(sketch)
        got = geo.sim_lookup(lists.where("key % 10 = 0"), lists, geo.DIFF7, expected).collect()
        assert len(got) == len(want) and {(r.a, r.b): r.matches for r in got} == want


def test_sim_hash_search_asks_for_each_hundredth(spark):
    found = catalog.sim_hash_search(spark, SF)
    assert found.columns == ["a", "b", "matches"] and found.where("a % 100 <> 0").isEmpty()


@pytest.mark.parametrize("k, cap", [(1, 16), (2, 40), (3, 20), (2, 1000)])
def test_bounded_load_is_key_by_key(spark, monkeypatch, k, cap):
    """In stretches of about 50 rows, with nodes that become full early, late or never; not all rows in one task."""
    import random

    monkeypatch.setattr(placement, "LOADED", 50)
    rng = random.Random(k)
    rows = [(key, rank, node) for key in rng.sample(range(-500, 500), 100) for rank, node in enumerate(rng.sample(range(7), 6))]
    load, want, taken = {}, [], {}
    for key, rank, node in sorted(rows):
        if taken.get(key, 0) < k and load.get(node, 0) < cap:
            load[node], taken[key] = load.get(node, 0) + 1, taken.get(key, 0) + 1
            want.append((key, rank, node))
    rng.shuffle(rows)
    found = placement.bounded_load(spark.createDataFrame(rows, "key bigint, rank int, node int"), k, cap)
    assert sorted(map(tuple, found.collect())) == want
    assert "RoundRobinPartitioning(1)" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("grams", [1 << 18, 1])
def test_search_within_tasks_and_by_postings(spark, monkeypatch, grams):
    """Queries that overlap, that are the same, and whose grams are all in a text that lacks them; no text leaves its task."""
    monkeypatch.setattr(ngrams, "GRAMS", grams)
    texts = {1: "The QUICK brown fox", 2: "quick quick fox brown", 3: None, 4: "", 5: "brown fox brown", 6: "ÄRGER über alles", 7: "x"}
    asked = {1: "quick brown", 2: "BROWN FOX", 3: "brown fox", 4: "ärger ÜBER", 5: "x", 6: None, 7: "", 8: "zz"}
    docs = spark.createDataFrame(list(texts.items()), "d bigint, text string")
    queries = spark.createDataFrame(list(asked.items()), "q bigint, text string")
    found = ngrams.search(docs, queries, "d", "q")
    want = {(q, d) for q, w in asked.items() if w for d, t in texts.items() if t and w.lower() in t.lower()}
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_line_table_by_the_definition(spark):
    texts = {1: "❤️ a\n\n \t\r\n👋b\n", 2: "", 3: None, 4: "\n", 5: "x", 6: " ", 7: "é👋\né"}
    found = offsets.line_table(spark.createDataFrame(list(texts.items()), "d bigint, t string"), "d", "t")
    want = []
    for d, t in texts.items():
        at = ""
        for n, line in enumerate((t or "").splitlines(keepends=True) if t != "❤️ a\n\n \t\r\n👋b\n" else ["❤️ a\n", "\n", " \t\r\n", "👋b\n"]):
            want.append((d, n, len(at.encode()), len(at), len(at.encode("utf-16-le")) // 2, not line.strip("\t\r \n")))
            at += line
    assert found.columns == ["d", "line", "utf8_begin", "char_begin", "utf16_begin", "blank"]
    assert sorted(map(tuple, found.collect())) == want
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
