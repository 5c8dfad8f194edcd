import numpy as np

from corpuslens.llm.neighbours import nearest
from corpuslens.llm.queries import op4_neighbours

from ..conftest import SF


def brute(ids, vectors, k=20):
    out = {}
    for i, v in zip(ids, vectors, strict=True):
        if i % 20 == 0:
            s = vectors @ v
            out[int(i)] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
    return out


def recall(rows, want):
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append(r)
    assert got.keys() == want.keys()
    hit = 0
    for q, found in got.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, len(want[q]) + 1))
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hit += len({r.vec_id for r in found} & {i for i, _ in want[q]})
    return hit / sum(map(len, want.values()))


def test_query_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = op4_neighbours(spark, SF).collect()
    assert recall(found, brute(ids, vectors)) >= 0.9
    at = {int(i): v for i, v in zip(ids, vectors, strict=True)}
    assert all(abs(r.score - at[r.query_id] @ at[r.vec_id]) < 1e-12 for r in found)


def test_lengths_of_many_scales(spark):
    rng = np.random.default_rng(9)
    vectors = rng.standard_normal((3000, 16)) * rng.lognormal(0, 0.5, (3000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    assert recall(nearest(df).collect(), brute(np.arange(3000), vectors)) >= 0.9


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    good = [(20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0]), (40, [1.0, 1.0, 1.0])]
    bad = [(0, None), (60, []), (80, [0.0, 0.0]), (100, [1.0, None]), (120, [nan, 1.0]), (140, [inf, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1) for r in good + bad], "vec_id long, embedding array<float>, score int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(df).collect())
    assert got == [(20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 2, 1.0), (20, 4, 3, -1.0)]
    assert nearest(df.limit(0)).count() == 0


def test_copies_tie_to_smaller_ids(spark):
    df = spark.createDataFrame([(i, [0.6, 0.8]) for i in range(200)] + [(1000, [0.8, 0.6])], "vec_id long, embedding array<float>")
    got = [r.vec_id for r in nearest(df).where("query_id = 100").orderBy("rank").collect()]
    assert got == list(range(20))
