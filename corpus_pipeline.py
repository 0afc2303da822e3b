"""From raw documents to packed training sequences: quality, language, near-duplicates, benchmarks, packing.

All stages but the last return rows of their input, unchanged, with all its columns, whatever these are called (names
with dots or backticks, other case, names of a stage's own results). A null text is an empty one: it is scored as such, has no
language (`und`) and so goes in the second stage. Repeated rows have equal scores and languages; of them one stays.
Ties of ids keep the row of the least hash of the text; a null doc_id comes last. Texts of any length are read whole.
An empty table gives an empty one of the same columns, and no sequences; without labels all documents are good, and
without languages to learn from none has one. Intermediate tables are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textsketch.llm import decontaminate, langid, nearcopies, packing, quality
from textsketch.llm.common import materialise

#: A text goes if less of its n-grams than this are known to its likeliest language.
LEAST_COVER = 0.25


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the compression classifier holds a good label likelier."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, model, 0.5)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents written in one of the languages that the corpus names; `und` and unknown ones go."""
    return langid.keep(docs, langid.train(docs), LEAST_COVER)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles with Jaccard similarity 0.8, or near fingerprints), the document of the smallest id."""
    return nearcopies.keep_one(docs)


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of what is left."""
    return packing.pack(docs)


STAGES = [("quality", keep_good), ("language", keep_languages), ("near_duplicates", keep_one_of_each), ("decontamination", keep_unleaked), ("packing", pack)]
#: Hashes over windows, compression and a genetic algorithm: no SQL expresses these.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
