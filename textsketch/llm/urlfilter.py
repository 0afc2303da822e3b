"""URL lists over time: entries become validity intervals, captures are judged as of their fetch.

DataFrame functions only. An entry's pattern is a domain, which holds for its subdomains, or a host with the
beginning of a path, which holds for that host. Captures are judged once for each distinct URL and
time; a URL's candidate patterns are looked up by equality, so that a busy host is
a skewed side of an equi-join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, pick, place

ALLOW = "allow"


def host(url: Column) -> Column:
    """The host in lower case, without user, port or a last dot; empty if there is none."""
    own = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^:/?#]*)", 1))
    return F.regexp_replace(own, r"\.$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)


def patterns(url: Column, lengths: Column) -> Column:
    """All patterns that hold for a URL: its domains, and its host with each beginning of its path that ends in / or makes one of these lengths."""
    labels, parts = F.split(host(url), r"\."), F.split(path(url), "/")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.concat(host(url), F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))
    whole = F.concat(host(url), path(url))
    others = F.transform(F.filter(lengths, lambda n: (n > F.length(host(url))) & (n <= F.length(whole))), lambda n: F.substring(whole, F.lit(1), n))
    return F.when(host(url) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, starts, others)))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, valid_from, valid_to): from each addition to the next change; without one, valid_to is null.

    Entries are (list, pattern, action add or remove, at). Of several actions at one time a removal wins;
    an addition to an entry that holds already changes nothing that shows; rows with a null are ignored.
    """
    clean = entries.where("list is not null and pattern is not null and at is not null and action in ('add', 'remove')")
    changes = clean.groupBy("list", "pattern", "at").agg(F.max("action").alias("action"))
    later = F.lead("at").over(Window.partitionBy("list", "pattern").orderBy("at"))
    return changes.withColumn("valid_to", later).where("action = 'add'").select("list", "pattern", F.col("at").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """captures, all columns, with blocked and reasons (list:pattern of the entries that held, in order).

    An entry of the list `allow` that held lifts all others. A capture without a URL, host or time
    is not blocked; repeated captures are judged alike; an empty list blocks nothing; columns
    called blocked or reasons, in any case, are replaced; others may have any name.
    """
    stay = [k for k, c in enumerate(captures.columns) if c.lower() not in ("blocked", "reasons")]
    own = numbered(captures).select(*(f"_{k}" for k in stay), F.col(f"_{place(captures, url)}").alias("url"), F.col(f"_{place(captures, at)}").alias("at"))
    entries = pick(entries, list="string", pattern="string", action="string", at="")
    asked = own.select("url", "at").where("url is not null and at is not null").distinct()
    lengths = entries.where("contains(pattern, '/') and not endswith(pattern, '/')").agg(F.collect_set(F.length("pattern")).alias("lengths"))
    keys = asked.crossJoin(F.broadcast(lengths)).select("url", "at", F.explode(patterns(F.col("url"), F.col("lengths"))).alias("pattern"))
    held = intervals(entries)
    met = keys.join(held, "pattern").where("valid_from <= at and (valid_to is null or at < valid_to)")
    reason = F.concat("list", F.lit(":"), "pattern")
    verdict = met.groupBy("url", "at").agg(F.array_sort(F.collect_set(reason)).alias("found"), F.bool_or(F.col("list") == ALLOW).alias("allowed"))
    out = own.join(verdict, ["url", "at"], "left")
    blocked = F.coalesce(~F.col("allowed"), F.lit(False))
    return out.select(*(f"_{k}" for k in stay), blocked, F.coalesce(F.array_join("found", ","), F.lit(""))).toDF(*(captures.columns[k] for k in stay), "blocked", "reasons")
