"""Total orders, bounded evidence, and checks of neighbouring rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import severity_rank


def worst_first(findings: DataFrame, keys: list[str], *ties: str) -> DataFrame:
    """``ord`` from 1 in each group: worst severity first, then the ties; the order is total if the ties are."""
    order = Window.partitionBy(*keys).orderBy(severity_rank("severity"), *ties)
    return findings.withColumn("ord", F.row_number().over(order))


def bounded_evidence(rows: DataFrame, keys: list[str], order: list[Column | str], value: str, most: int) -> DataFrame:
    """The first ``most`` values of each group, and one row that counts the rest.

    The rest is counted by aggregation, so that the window keeps no more than ``most`` rows of a group.
    """
    kept = rows.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("ord") <= most)
    note = F.concat(F.lit("…and "), (F.col("_n") - most).cast("string"), F.lit(" more"))
    rest = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*keys, F.lit(most + 1).alias("ord"), F.lit(None).cast(rows.schema[value].dataType).alias(value), note.alias("note"))
    return kept.select(*keys, "ord", value, F.lit(None).cast("string").alias("note")).unionByName(rest)


def first_violation(rows: DataFrame, key: str, order: str, bad: Column, **previous: str) -> DataFrame:
    """The first row of each group, in order, for which ``bad`` holds; ``previous`` names columns of the row before."""
    by = Window.partitionBy(key).orderBy(order)
    seen = rows
    for name, column in previous.items():
        seen = seen.withColumn(name, F.lag(column).over(by))
    return seen.where(bad).groupBy(key).agg(F.min(order).alias(order))
