"""Encoded tokens and credential lines in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import charset_of


def encoded_tokens(texts: DataFrame, keys: list[str], text: str, floor: int = 48) -> DataFrame:
    """(keys, token, charset): long tokens that look like base64 or hex."""
    found = texts.select(*keys, F.explode(F.regexp_extract_all(F.col(text), F.lit(f"([A-Za-z0-9+/=]{{{floor},}})"), F.lit(1))).alias("token"))
    return found.withColumn("charset", charset_of("token")).where("charset is not null")


def matching_lines(texts: DataFrame, keys: list[str], text: str, pattern: str) -> DataFrame:
    """(keys, line, value): lines, numbered from 1, that match the pattern."""
    lines = texts.where(F.col(text).rlike(pattern)).select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("at", "value"))
    return lines.where(F.col("value").rlike(pattern)).select(*keys, (F.col("at") + 1).alias("line"), "value")
