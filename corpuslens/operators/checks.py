"""Integrity constraints over tables: one pass, every rule counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def broken_rules(rows: DataFrame, table: str, rules: dict[str, Column]) -> DataFrame:
    """(table, rule, broken, checked): how many rows break each rule; a null condition breaks it."""
    counted = rows.agg(F.count("*").alias("checked"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"r{i}") for i, c in enumerate(rules.values())])
    each = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("broken")) for i, name in enumerate(rules)])
    return counted.select(F.lit(table).alias("table_name"), F.explode(each).alias("x"), "checked").select("table_name", "x.rule", "x.broken", "checked")
