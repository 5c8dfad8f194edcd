"""Aggregations over findings and observations: counts, grade, thresholds, first use, digests, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import SEVERITIES, grade_of, is_graded, severity_rank


def severity_counts(findings: DataFrame, *keys: str) -> DataFrame:
    """A column for each severity, zeros kept."""
    return findings.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def grades(findings: DataFrame, *keys: str) -> DataFrame:
    """The grade of each group by its worst graded finding."""
    worst = F.min(F.when(is_graded("severity", "confidence"), severity_rank("severity")))
    return findings.groupBy(*keys).agg(worst.alias("worst")).withColumn("grade", grade_of("worst"))


def breaches(findings: DataFrame, level: str, *keys: str) -> DataFrame:
    """Whether a graded finding of a group is as bad as ``level`` or worse."""
    hit = is_graded("severity", "confidence") & (severity_rank("severity") <= SEVERITIES.index(level))
    return findings.groupBy(*keys).agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("breach"))


def first_use(uses: DataFrame, keys: list[str], order: Column, values: list[str]) -> DataFrame:
    """The values of the first use of each group."""
    site = F.min_by(F.struct(*values), order)
    return uses.groupBy(*keys).agg(site.alias("_site"), F.count("*").alias("uses")).select(*keys, *[F.col("_site")[v].alias(v) for v in values], "uses")


def observation_counts(facts: DataFrame, *keys: str) -> DataFrame:
    """Equal facts counted; a count of one is left out (null), as the report format has it."""
    return facts.groupBy(*keys).agg(F.count("*").alias("_n")).select(*keys, F.when(F.col("_n") > 1, F.col("_n")).alias("count"))


def ordered_digest(rows: DataFrame, group: str, order: str, line: Column, bucket: Column) -> DataFrame:
    """SHA-256 of each group's lines in order: of the digests of its buckets, which hold runs of the order.

    A bucket bounds what one task collects; only digests of buckets meet for the whole group.
    """
    lines = rows.select(group, bucket.alias("_bucket"), F.struct(F.col(order), line.alias("line")).alias("_item"))
    joined = lambda items: F.array_join(F.transform(F.array_sort(items), lambda i: i["line"]), "\n")
    parts = lines.groupBy(group, "_bucket").agg(F.sha2(joined(F.collect_list("_item")), 256).alias("line"), F.count("*").alias("_n"))
    whole = parts.select(group, "_n", F.struct(F.col("_bucket"), F.col("line")).alias("_item")).groupBy(group)
    return whole.agg(F.concat(F.lit("sha256:"), F.sha2(joined(F.collect_list("_item")), 256)).alias("digest"), F.sum("_n").alias("files"))


def coverage(rows: DataFrame, covered: Column, *keys: str) -> DataFrame:
    """candidates, covered, and the status: complete, partial, or unknown where nothing is covered."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("candidates"), F.count_if(covered).alias("covered"))
    status = F.when(F.col("covered") == 0, "unknown").when(F.col("covered") < F.col("candidates"), "partial").otherwise("complete")
    return counted.withColumn("status", status)
