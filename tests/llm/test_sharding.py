import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from corpuslens.llm.queries import op9_sharding
from corpuslens.llm.common import scratch
from corpuslens.llm.sharding import hilbert_index, quantise_log, shard_rows, write_shards

from ..conftest import SF


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 2)])
def test_curve_visits_neighbours(spark, n, bits):
    cells = list(itertools.product(range(1 << bits), repeat=n))
    df = spark.createDataFrame(cells, ", ".join(f"c{i} int" for i in range(n)))
    walk = [tuple(r)[:n] for r in sorted(df.select("*", hilbert_index([F.col(f"c{i}") for i in range(n)], bits).alias("h")).collect(), key=lambda r: r.h)]
    assert len(set(walk)) == len(cells)
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in zip(walk, walk[1:], strict=False))


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op9_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw) and r.grown_shard is None and r.law == "rows"
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(by) == list(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


@pytest.mark.parametrize("n", [0, 1, 5, 24, 100])
def test_edges(spark, n):
    df = spark.createDataFrame([(i % 7 if i % 3 else None, "same", "c") for i in range(n)], "k long, v string, count string")
    got = shard_rows(df, [F.coalesce(F.col("k"), F.lit(0)), F.lit(0)], [F.col("k")], 24).collect()
    counts = [sum(r.shard == s for r in got) for s in range(24)]
    assert len(got) == n and sum(counts) == n and max(counts) - min(counts) <= 1
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))


def test_files_prune(spark):
    rows = spark.range(4000).selectExpr("id", "cast(pmod(xxhash64(id), 500) as int) as a", "cast(pmod(xxhash64(id, 1), 500) as int) as b")
    dealt = shard_rows(rows, [F.col("a") % 256, F.col("b") % 256], [F.col("id")], 16)
    folder = scratch(spark, "shards")
    write_shards(dealt, folder, 50)
    back = spark.read.parquet(folder)
    assert back.count() == 4000 and back.where("shard = 3").count() == 250
    files = spark.read.parquet(folder).select("*", F.col("_metadata.file_path").alias("f")).where("a < 256 and b < 256").groupBy("f").agg(*[F.max(c) - F.min(c) for c in ("a", "b")]).collect()
    assert len(files) >= 16 and sum(r[1] < 130 and r[2] < 130 for r in files) > len(files) * 0.8


def test_quantised_sizes(spark):
    got = spark.createDataFrame([(None,), (-5,), (0,), (1,), (1 << 60,)], "n long").select(quantise_log(F.col("n")).alias("q")).collect()
    assert [r.q for r in got] == [0, 0, 0, 8, 255]


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, "a", 1, 2, 3) for i in range(50)], "_curve long, _in string, _pid int, __0 int, _rank int")
    got = shard_rows(df, [F.col("_curve") % 8, F.lit(0)], [F.col("_in")], 4)
    assert got.columns == [*df.columns, "shard", "slot"] and got.groupBy("shard").count().where("count not in (12, 13)").count() == 0
    assert sorted(r._curve for r in got.collect()) == list(range(50))
    with pytest.raises(ValueError, match="shard"):
        shard_rows(df.withColumnRenamed("_in", "Shard"), [F.lit(0)], [], 4)


def test_equal_texts_yield_to_the_law(spark):
    """A third of all rows are copies: counts stay equal, copies with equal metadata are neighbours on the curve."""
    df = spark.range(90).selectExpr("id", "if(id % 3 = 0, 'copy', cast(id AS string)) AS text", "cast(0 AS long) AS size")
    got = shard_rows(df, [F.col("size"), F.lit(0)], [F.xxhash64("text"), F.col("id")], 9).collect()
    places = sorted(r.shard * 10 + r.slot for r in got if r.text == "copy")
    assert places == list(range(places[0], places[0] + 30)) and len({p // 10 for p in places}) >= 3
