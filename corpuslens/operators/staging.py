"""How work is laid out: rows dealt to tasks, and lineage cuts, tables written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only in local mode (tests). On a cluster without one this raises."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="corpuslens-"))
    return context._jsc.sc().getCheckpointDir().get()


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by the keys to as many tasks as the session has shuffle partitions.

    The number is named because Spark merges partitions of few bytes otherwise, however long Python takes for their rows.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def merged(rows: DataFrame) -> DataFrame:
    """``rows`` as a side of a join that is never broadcast: one for a file or a pair of files.

    Spark goes by the size of a table's files, and paths and facts compress so well that a driver would run out of memory.
    """
    return rows.hint("merge")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: computed by one job, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpuslens/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
