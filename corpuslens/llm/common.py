"""Shared pieces of the training-data operators: durable staging, fixed-size membership bitmaps, Arrow maps.

Nothing here keeps data on one machine: intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir``, so a lost executor costs a recomputed task and never a wrong result.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; long documents make wide rows, so batches stay short.
BATCH_ROWS = 512
#: A narrow table is written by so many tasks for each core, or one for so many shuffle partitions, whichever are more.
FILES, MERGE = 2, 16
#: log2 of the bits of a membership bitmap: 2**25 bits are 4 MB whatever the input's size.
BITMAP_BITS = 25
#: A key is hot if it holds more than one of so many rows; there are never more hot keys than that.
HOT = 1024
_scopes: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see; a temporary one only in local mode (tests). On a cluster without one this raises."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            return set_before.get()
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="corpuslens-")
        spark.sparkContext.setCheckpointDir(where)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return "/".join([shared_dir(spark), "corpuslens", *_scopes, f"{label}-{uuid.uuid4().hex}"])


def stage(spark: SparkSession, df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, survives lost executors.

    narrow: a table of a few numbers a row; its small partitions are written by fewer tasks, no row is moved.
    """
    path = scratch(spark, label)
    if narrow:
        df = df.coalesce(max(FILES * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // MERGE, 1))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, folder: str | None = None) -> None:
    """Removes every intermediate table of the shared folder, or of ``folder``; results must be written by then."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder or f"{shared_dir(spark)}/corpuslens")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables that are made inside are removed at the end; what was computed from them must be written by then."""
    folder = scratch(spark, "scope")
    _scopes.append(folder.rsplit("/", 1)[1])
    try:
        yield
    finally:
        _scopes.pop()
        drop_scratch(spark, folder)


def free_names(*taken: DataFrame, count: int) -> list[str]:
    """Column names that none of the tables has, whatever the case of theirs."""
    known = {c.lower() for df in taken for c in df.columns}
    return [f"__{i}" for i in range(count + len(known)) if f"__{i}" not in known][:count]


def join_keyed(rows: DataFrame, keyed: DataFrame, on: list[str], size: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed``, a staged table with one row for each key; ``size`` says how many of the rows hold it.

    A key that holds more than one row in HOT doesn't meet in one task: such keys are at most HOT, so they are
    broadcast, the others are joined by whatever Catalyst picks. Keys must not be null.
    """
    whole = keyed.agg(F.sum(size), F.max(size)).first()
    if whole[0] is None or whole[1] * HOT <= whole[0]:
        return rows.join(keyed.drop(size), on, how)
    hot = F.col(size) * HOT > whole[0]
    often = F.broadcast(keyed.where(hot).drop(size))
    rare = rows.join(F.broadcast(keyed.where(hot).select(on)), on, "left_anti").join(keyed.where(~hot).drop(size), on, how)
    return rows.join(often, on).unionByName(rare)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` over every Arrow batch of ``df``."""
    _short_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(run, schema)


def arrow_stream(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` over the batch iterator of every partition."""
    _short_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def join_salted(rows: DataFrame, keyed: DataFrame, on: str, by: str) -> DataFrame:
    """``rows``, a staged table, inner joined with ``keyed``, which has one row for each key and may have wide ones.

    Rows of a hot key are dealt by their column ``by`` to as many copies of the key's row as the key is times hotter than
    one in HOT; all copies together are under 2 * HOT. Keys must not be null.
    """
    copies, salt = free_names(rows, keyed, count=2)
    counts = rows.groupBy(on).agg(F.count("*").alias(copies))
    total = rows.count()
    hot = counts.where(F.col(copies) * HOT > total).select(on, F.ceil(F.col(copies) * HOT / max(total, 1)).cast("int").alias(copies)).toArrow()
    if not len(hot):
        return rows.join(keyed, on)
    spark = rows.sparkSession
    known = F.broadcast(spark.createDataFrame(hot))
    left = rows.join(known, on, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(by), F.col(copies)), F.lit(0)).cast("int")).drop(copies)
    right = keyed.join(known, on, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(copies), F.lit(1)) - 1))).drop(copies)
    return left.join(right, [on, salt]).drop(salt)


def _short_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS and leaves them so: Spark reads the setting when a plan runs, which is up to the caller."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """Membership bitmap of the 64-bit hashes in ``column``, 2**BITMAP_BITS bits: no member is missed, a few others pass.

    The bits are or-ed on the executors; at most 2**(BITMAP_BITS - 6) words reach the driver, whatever the input.
    """
    h = F.col(column)
    words = (
        hashes.where(h.isNotNull())
        .select(F.shiftrightunsigned(h, 6).bitwiseAND((1 << (BITMAP_BITS - 6)) - 1).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
    )
    got = words.toArrow()
    bits = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.uint64)
    bits[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return bits


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Mask of the hashes that may be members."""
    h = hashes.view(np.uint64)
    w = ((h >> np.uint64(6)) & np.uint64(len(bits) - 1)).astype(np.int64)
    return (bits[w] >> (h & np.uint64(63))) & np.uint64(1) != 0
