"""The registered queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hmm, htmltext, itq, langid, licences, packing, quality, simhash, urlfilter
from .common import fold_number


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", (fold_number("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_cover")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    found = quality.score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold_number("doc_id", 3) == 1).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op6_language": op6_language,
    "op7_quality": op7_quality,
    "op9_simhash": op9_simhash,
    "op10_decontaminate": op10_decontaminate,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {}


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = htmltext.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), "n_chars")


#: The pages have no fetch time and no lists come with them: both are made from ids and hosts, in SQL and here alike.
_CAPTURES = "SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INT) AS fetched_on FROM pages"
_ENTRIES = """
SELECT 'spam' AS list, host AS pattern, 'add' AS action, DATE '2024-01-01' + CAST(n % 200 AS INT) AS day FROM hosts WHERE n % 3 = 0
UNION ALL SELECT 'spam', host, 'remove', DATE '2024-01-01' + CAST(n % 200 + 60 AS INT) FROM hosts WHERE n % 6 = 0
UNION ALL SELECT 'spam', host, 'add', DATE '2024-01-01' + CAST(n % 200 + 120 AS INT) FROM hosts WHERE n % 12 = 0
UNION ALL SELECT 'adult', parent, 'add', DATE '2024-01-01' + CAST(n % 300 AS INT) FROM hosts WHERE n % 7 = 0 AND parent <> ''
UNION ALL SELECT 'legal', host || '/en/', 'add', DATE '2024-01-01' + CAST(n % 250 AS INT) FROM hosts WHERE n % 5 = 0
UNION ALL SELECT 'legal', host || '/de/', 'add', DATE '2024-01-01' + CAST(n % 250 AS INT) FROM hosts WHERE n % 5 = 1
UNION ALL SELECT 'allow', host, 'add', DATE '2024-01-01' + CAST(n % 366 AS INT) FROM hosts WHERE n % 11 = 0
"""


def op5_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.expr("DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INT)").alias("fetched_on"))
    hosts = pages.select(urlfilter.host(F.col("url")).alias("host")).where("host <> ''").distinct()
    hosts = hosts.withColumn("n", F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int")).withColumn("parent", F.regexp_extract("host", r"^[^.]*\.(.*\..*)$", 1))
    entries = spark.sql(_ENTRIES.replace("FROM hosts", "FROM {hosts}"), hosts=hosts).withColumnRenamed("day", "at")
    return urlfilter.judge(captures, entries, at="fetched_on").select("page_id", "url", "fetched_on", "blocked", "reasons")


_OP5 = (
    r"""WITH raw AS (SELECT *, rtrim_dot AS host FROM (SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INT) AS fetched_on,
  regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^:/?#]*)', 1)), '\.$', '') AS rtrim_dot,
  regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1) AS path FROM pages)),
hosts AS (SELECT host, CAST('0x' || substr(md5(host), 1, 4) AS INT) AS n, regexp_extract(host, '^[^.]*\.(.*\..*)$', 1) AS parent FROM (SELECT DISTINCT host FROM raw WHERE host <> '')),
entries AS ("""
    + _ENTRIES
    + r"""),
changes AS (SELECT list, pattern, day, max(action) AS action FROM entries GROUP BY ALL),
spans AS (SELECT *, lead(day) OVER (PARTITION BY list, pattern ORDER BY day) AS until FROM changes),
held AS (SELECT * FROM spans WHERE action = 'add'),
met AS (SELECT r.page_id, r.url, r.fetched_on, h.list, h.pattern FROM raw r JOIN held h ON h.day <= r.fetched_on AND (h.until IS NULL OR r.fetched_on < h.until)
  AND CASE WHEN contains(h.pattern, '/') THEN starts_with(r.host || r.path, h.pattern) ELSE r.host = h.pattern OR ends_with(r.host, '.' || h.pattern) END WHERE r.host <> ''),
verdicts AS (SELECT url, fetched_on, bool_or(list = 'allow') AS allowed, array_to_string(list_sort(list(DISTINCT list || ':' || pattern)), ',') AS reasons FROM met GROUP BY ALL)
SELECT r.page_id, r.url, r.fetched_on, coalesce(NOT v.allowed, false) AS blocked, coalesce(v.reasons, '') AS reasons FROM raw r LEFT JOIN verdicts v USING (url, fetched_on)"""
)


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "first_line", "last_line", "licence", F.round("dice", 6).alias("dice"))


def _op8() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(name)}, {k}, {quoted(t)})" for name, texts in licences.TEMPLATES.items() for k, t in enumerate(texts))
    grams = lambda t: rf"list_transform(regexp_extract_all(lower({t}), '[\pL\pN_]+'), lambda w: regexp_replace(w, '^[0-9]+$', '#'))"
    pairs = lambda w: f"list_distinct(list_transform(range(1, len({w})), lambda k: {w}[k] || ' ' || {w}[k + 1]))"
    need = f"ceil({licences.THRESHOLD} * len(g) / (2 - {licences.THRESHOLD}) - 1e-9)"
    return rf"""WITH cut AS (SELECT doc_id, row_number() OVER () AS r, str_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, r, unnest(range(len(l))) AS k, unnest(l) AS line FROM cut),
runs AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) = '' AS blank, sum(CASE WHEN trim(line, ' ' || chr(9) || chr(13)) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY k) AS run FROM lines),
units AS (SELECT doc_id, r, k AS a, k AS b, line AS t FROM lines
 UNION SELECT doc_id, r, min(k), max(k), string_agg(line, chr(10) ORDER BY k) FROM runs WHERE NOT blank GROUP BY doc_id, r, run
 UNION SELECT doc_id, r, 0, len(l) - 1, array_to_string(l, chr(10)) FROM cut),
worded AS (SELECT doc_id, r, a, b, {grams("t")} AS w FROM units),
own AS (SELECT doc_id, r, a, b, {pairs("w")} AS g FROM worded WHERE len(w) > 1),
templates AS (SELECT licence, k AS id, len(w) AS n, {pairs("w")} AS g FROM (SELECT licence, k, {grams("t")} AS w FROM (VALUES {rows}) AS v(licence, k, t))),
scored AS (SELECT doc_id, r, a, b, licence, 2.0 * len(list_intersect(o.g, x.g)) / (len(o.g) + len(x.g)) AS dice FROM own o JOIN templates x ON 2 * least(len(o.g), len(x.g)) >= {licences.THRESHOLD} * (len(o.g) + len(x.g))),
words AS (SELECT doc_id, r, k, unnest({grams("line")}) AS word, unnest(range(len({grams("line")}))) AS i FROM lines),
sequence AS (SELECT doc_id, r, list(word ORDER BY k, i) AS w, list(k ORDER BY k, i) AS of FROM words GROUP BY doc_id, r),
listed AS (SELECT *, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) AS p FROM sequence WHERE len(w) > 1),
near AS (SELECT l.*, x.* FROM listed l JOIN templates x ON len(l.w) >= x.n AND len(list_intersect(l.p, x.g)) >= {need.replace("len(g)", "len(x.g)")}),
starts AS (SELECT doc_id, r, of, licence, id, n, g, s, list_distinct(p[s + 1:s + n - 1]) AS d FROM (SELECT *, unnest(range(len(w) - n + 1)) AS s FROM near)),
high AS (SELECT *, 2.0 * len(list_intersect(d, g)) / (len(d) + len(g)) AS dice FROM starts),
ordered AS (SELECT *, s - lag(s) OVER (PARTITION BY r, licence, id ORDER BY s) > n AS fresh FROM high WHERE dice >= {licences.THRESHOLD}),
parted AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY r, licence, id ORDER BY s) AS part FROM ordered),
windows AS (SELECT doc_id, r, of[s + 1] AS a, of[s + n] AS b, licence, dice FROM parted QUALIFY row_number() OVER (PARTITION BY r, licence, id, part ORDER BY dice DESC, s) = 1),
all_of AS (SELECT * FROM scored WHERE dice >= {licences.THRESHOLD} UNION ALL SELECT * FROM windows)
SELECT doc_id, CAST(a AS INT) AS first_line, CAST(b AS INT) AS last_line, licence, round(dice, 6) AS dice FROM all_of
QUALIFY row_number() OVER (PARTITION BY r, a, b ORDER BY dice DESC, licence) = 1"""


QUERIES |= {"op4_html": op4_html, "op5_url": op5_url, "op8_licences": op8_licences}
ORACLES |= {"op5_url": _OP5, "op8_licences": _op8()}


def op3_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(_table(spark, sf_dir, "embeddings"))


QUERIES |= {"op3_itq": op3_itq}


def op2_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(_table(spark, sf_dir, "documents"), fold_number("doc_id", 5) == 1)


QUERIES |= {"op2_hmm": op2_hmm}
