"""Operator 9: shards as runs of a Hilbert curve over several metadata dimensions.

Each dimension is quantised to BITS bits, the cell's index on the Hilbert curve orders the rows, and the order is cut
into runs of equal row counts (law ``rows``: at most one apart). Near rows on the curve are near in every dimension, so
the min/max statistics of a shard's files prune on any of them.

The curve index is a DataFrame expression; the order is a range partitioning whose partition sizes (one row each) give
the offsets, so no partition is ever the whole table and rows are shuffled once. Rows that tie on the curve are ordered
by text hash, then id: copies with equal metadata lie side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, stage

BITS = 8


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of the cell ``dims``, each an integer in [0, 2**bits); Skilling's transform as expressions over one array column.

    Each step is a lambda over the array of the step before, so that nothing is evaluated twice and plans stay small.
    """
    n = len(dims)
    x = F.array(*[d.cast("long") for d in dims])
    at = lambda a, i: F.element_at(a, i + 1)
    for b in range(bits - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        for i in range(n):
            x = F.element_at(F.transform(F.array(x), _rotate(i, n, q, p)), 1)

    def gray(a):
        out = [at(a, 0)]
        for i in range(1, n):
            out.append(at(a, i).bitwiseXOR(out[-1]))
        return F.array(*out)

    def turned(a):
        turn = F.lit(0).cast("long")
        for b in range(bits - 1, 0, -1):
            turn = turn.bitwiseXOR(F.when(at(a, n - 1).bitwiseAND(1 << b) != 0, (1 << b) - 1).otherwise(0).cast("long"))
        return F.array(*[at(a, i) for i in range(n)], turn)

    def interleaved(a):
        index = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for i in range(n):
                bit = F.shiftright(at(a, i).bitwiseXOR(at(a, n)), b).bitwiseAND(1)
                index = index.bitwiseOR(F.shiftleft(bit, b * n + n - 1 - i))
        return index

    for part in (gray, turned, interleaved):
        x = F.element_at(F.transform(F.array(x), part), 1)
    return x


def _rotate(i: int, n: int, q: int, p: int):
    """One step of the transform for dimension ``i``, over the array of coordinates."""

    def step(a: Column) -> Column:
        at = lambda j: F.element_at(a, j + 1)
        hit = at(i).bitwiseAND(q) != 0
        swap = at(0).bitwiseXOR(at(i)).bitwiseAND(p)
        first = F.when(hit, at(0).bitwiseXOR(p)).otherwise(at(0).bitwiseXOR(swap))
        return F.array(first, *[F.when(hit, at(j)).otherwise(at(j).bitwiseXOR(swap)) if j == i else at(j) for j in range(1, n)])

    return step


def quantise_log(value: Column, bits: int = BITS) -> Column:
    """A size on a log scale: eight cells for each doubling; null and negative sizes are 0."""
    cell = F.floor(F.log2(F.greatest(F.coalesce(value, F.lit(0)), F.lit(0)) + 1) * 8)
    return F.least(cell, F.lit((1 << bits) - 1)).cast("long")


def quantise_name(value: Column, bits: int = BITS) -> Column:
    """A name to one of 2**bits - 1 cells by hash; null is 0."""
    return F.when(value.isNull(), 0).otherwise(F.pmod(F.xxhash64(value), F.lit((1 << bits) - 1)) + 1).cast("long")


def shard_rows(rows: DataFrame, dims: list[Column], tie: list[Column], shards: int) -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` (gapless from 0 in its shard). Counts of shards are at most one apart.

    The law of counts comes first: equal rows are neighbours in the order, but a cut may part them. Repeated rows are
    separate rows; with fewer rows than shards, some shards are empty; an empty table gives no rows. Columns ``shard`` or
    ``slot`` of ``rows`` are an error, other names are free.
    """
    spark = rows.sparkSession
    clash = {c.lower() for c in rows.columns} & {"shard", "slot"}
    if clash:
        raise ValueError(f"columns of the table have names of the result: {', '.join(sorted(clash))}")
    curve, part, place, count, before, total, rank, *ties = free_names(rows, count=7 + len(tie))
    order = [curve, *ties]
    keyed = rows.select("*", hilbert_index(dims).alias(curve), *[t.alias(n) for t, n in zip(tie, ties, strict=True)])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # numbered where they are sorted and written: an id has the partition above the row's place in it
    numbered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop(*order).withColumn(place, F.monotonically_increasing_id())
    numbered = stage(spark, numbered.withColumn(part, F.shiftright(place, 33).cast("int")).withColumn(place, F.col(place).bitwiseAND((1 << 33) - 1)), "curve")
    # One row a partition: its number is set by the cluster, not by the data.
    counts = numbered.groupBy(part).agg(F.count("*").alias(count))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(part, F.coalesce(F.sum(count).over(earlier), F.lit(0)).alias(before), F.sum(count).over(Window.partitionBy()).alias(total))
    ranked = numbered.join(F.broadcast(offsets), part).withColumn(rank, (F.col(before) + F.col(place)).cast("long"))
    # shard s begins at rank ceil(s * total / shards)
    whole = ranked.withColumn("shard", F.expr(f"cast(({rank} * {shards}L) div {total} as int)"))
    start = F.expr(f"(cast(shard as long) * {total} + {shards - 1}L) div {shards}L")
    return whole.withColumn("slot", (F.col(rank) - start).cast("long")).drop(part, place, before, total, rank)


def write_shards(dealt: DataFrame, folder: str, rows_per_file: int = 1_000_000) -> None:
    """Writes what ``shard_rows`` returns as Parquet, a folder for each shard, in files of runs of ``slot``.

    A file holds one run of the curve, so its column statistics prune on every dimension; a shard of any size is many
    files, none written by more than one task.
    """
    (run,) = free_names(dealt, count=1)
    runs = dealt.withColumn(run, F.expr(f"slot div {rows_per_file}"))
    runs.repartition("shard", run).sortWithinPartitions("shard", run, "slot").drop(run).write.partitionBy("shard").parquet(folder)
