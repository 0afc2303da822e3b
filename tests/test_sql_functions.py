from pyspark.sql import functions as F

from textsketch.functions import fold, hashing, offsets, sql


def test_sql_functions_equal_columns(spark):
    assert "simple_fold" in sql.register(spark)
    df = spark.createDataFrame([("ÜBER Kelvin\nline ❤️ two\n", b) for b in range(36)] + [("", 0), (None, 1), ("plain ASCII", 3)], "t string, b int")
    df.createOrReplaceTempView("texts")
    got = spark.sql("SELECT simple_fold(t) a, md5_64(t) b, text_lines(t) c, utf8_to_line(t, b) d, utf8_to_char(t, b) e, char_to_utf8(t, b) f, unsigned_order(b) g FROM texts")
    t, b = F.col("t"), F.col("b")
    want = df.select(fold.simple_fold(t), hashing.md5_64(t), offsets.lines(t), offsets.utf8_to_line(t, b), offsets.utf8_to_char(t, b), offsets.char_to_utf8(t, b), hashing.unsigned(b.cast("bigint")))
    assert list(map(tuple, got.collect())) == list(map(tuple, want.collect()))


def test_positions_in_sql_equal_columns_and_the_index(spark):
    """Every position function, at every byte of texts with characters of all lengths, three ways."""
    import numpy as np

    from textsketch.functions.offset_index import OffsetIndex

    sql.register(spark)
    texts = ["ÜBER Kelvin\nline ❤️ two 👋x\n\n \t\r\nend", "", "\n", "a\n", "👋"]
    df = spark.createDataFrame([(t, k) for t in texts for k in range(len(t.encode()) + 3)], "t string, k int")
    df.createOrReplaceTempView("positions")
    one = "utf8_to_line utf8_to_char char_to_utf8 utf8_to_utf16 line_to_utf8_begin line_to_utf8_end line_to_char_begin line_to_char_end line_to_utf16_begin line_to_utf16_end only_whitespaces".split()
    two = "utf8s_to_lines utf8s_to_chars chars_to_utf8s lines_to_utf8s lines_to_chars chars_to_lines".split()
    more = "line_to_utf8s line_to_chars line_chars utf8_to_char_pos utf8_to_utf16_pos".split()
    got = spark.sql("SELECT t, k, " + ", ".join([f"{f}(t, k) {f}" for f in one + more] + [f"{f}(t, k, k + 2) {f}" for f in two]) + " FROM positions").collect()
    t, k = F.col("t"), F.col("k")
    want = df.select("t", "k", *(getattr(offsets, f)(t, k).alias(f) for f in one + more), *(getattr(offsets, f)(t, k, k + 2).alias(f) for f in two)).collect()
    assert list(map(tuple, got)) == list(map(tuple, want))
    for r in got:
        index = OffsetIndex(r.t)
        at = np.array([r.k])
        for f in one:
            if f != "utf8_to_utf16" or r.k >= index.length or index.chars.get(r.k):
                assert getattr(index, f)(at)[0] == r[f], (f, r)
        assert tuple(int(x[0]) for x in index.utf8_to_char_pos(at)) == tuple(r.utf8_to_char_pos)
        assert tuple(int(x[0]) for x in index.utf8s_to_lines(at, at + 2)) == tuple(r.utf8s_to_lines)
        assert tuple(int(x[0]) for x in index.chars_to_lines(at, at + 2)) == tuple(r.chars_to_lines)


def test_bit_rank():
    import numpy as np

    from textsketch.functions.offset_index import BitRank

    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        bits = rng.random(n) < 0.4
        of, places = BitRank(bits), np.arange(-2, n + 3)
        assert of.rank(places).tolist() == [int(bits[: max(0, p)].sum()) for p in places]
        assert of.get(places).tolist() == [bool(0 <= p < n and bits[p]) for p in places]
        ones = np.flatnonzero(bits).tolist()
        assert of.max_rank() == len(ones) and of.select(np.arange(len(ones) + 2)).tolist() == [*ones, n, n]
