"""How a rule's rows become findings.

A rule's part gives rows (pkg_id, ord, evidence) that are one finding for each package. Evidence is kept in the order of
``ord``; only the first ``most`` rows of a package are gathered, the rest is counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVIDENCE = "struct<file:string,line:int,snippet:string,note:string>"
FINDING = ["pkg_id", "rule", "variant", "title", "severity", "confidence", "evidence", "remediation"]


def evidence(file: Column | str = "file", line: Column | str | None = None, snippet: Column | str | None = None, note: Column | str | None = None) -> Column:
    column = lambda c, kind: F.lit(None).cast(kind) if c is None else (F.col(c) if isinstance(c, str) else c).cast(kind)
    return F.struct(column(file, "string").alias("file"), column(line, "int").alias("line"), column(snippet, "string").alias("snippet"), column(note, "string").alias("note")).alias("evidence")


def finding(
    rows: DataFrame, rule: str, variant: str, title: Column | str, severity: Column | str, confidence: Column | str, remediation: str, *, most: int | None = None, count_rest: bool = True, flags: dict[str, Column] | None = None
) -> DataFrame:
    """One finding for each package that has rows (pkg_id, ord, evidence).

    title, severity and confidence may use ``flags``, aggregates over all rows of the package.
    """
    literal = lambda c: F.lit(c) if isinstance(c, str) else c
    place = F.row_number().over(Window.partitionBy("pkg_id").orderBy("ord"))
    kept = rows.withColumn("_place", place)
    item = F.struct("_place", "evidence")
    if most is not None:
        item = F.when(F.col("_place") <= most, item)
    grouped = kept.groupBy("pkg_id").agg(F.array_sort(F.collect_list(item)).alias("_items"), F.count("*").alias("_n"), *[c.alias(k) for k, c in (flags or {}).items()])
    gathered = F.transform("_items", lambda i: i["evidence"])
    if most is not None and count_rest:
        rest = F.struct(F.lit(".").alias("file"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("snippet"), F.concat(F.lit("…and "), (F.col("_n") - most).cast("string"), F.lit(" more")).alias("note"))
        gathered = F.when(F.col("_n") > most, F.concat(gathered, F.array(rest))).otherwise(gathered)
    return grouped.select("pkg_id", F.lit(rule).alias("rule"), F.lit(variant).alias("variant"), literal(title).alias("title"), literal(severity).alias("severity"), literal(confidence).alias("confidence"), gathered.cast(f"array<{EVIDENCE}>").alias("evidence"), F.lit(remediation).alias("remediation"))


def subject(rows: DataFrame, rule: str, variant: Column | str, file: Column | str, value: Column | str) -> DataFrame:
    """Stable subjects (pkg_id, rule, variant, file, subject), one for each row."""
    kind = F.lit(variant) if isinstance(variant, str) else variant
    column = lambda c: F.col(c) if isinstance(c, str) else c
    return rows.select("pkg_id", F.lit(rule).alias("rule"), kind.alias("variant"), column(file).alias("file"), column(value).alias("subject"))
