"""From raw documents to packed training windows: five stages, each one operator of corpuslens.llm over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuslens.llm.common import scratch, scratch_scope, table
from corpuslens.llm.leaks import drop_leaks
from corpuslens.llm.lines import drop_duplicate_lines
from corpuslens.llm.neardup import keep_one
from corpuslens.llm.packing import pack
from corpuslens.llm.quality import keep_good
from corpuslens.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more. It learns from ``labels`` on the documents it is given."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines, equal or within one word edit; those of repeated lines alone go."""
    return drop_duplicate_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ``benchmark``."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 ids."""
    return pack(docs, tokenizer_path()).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: No stage can be put in SQL that DuckDB runs; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each but the last written and read again. A stage's own tables go when it is written."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        path = scratch(spark, name)
        with scratch_scope(spark):
            done = function(spark, docs, sf_dir)
            done.write.parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
