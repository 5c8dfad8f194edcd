import re

import numpy as np
import pytest

from corpuslens.llm.graph import components
from corpuslens.llm.kernels import Spans, mix, words
from corpuslens.llm.neardup import _samples, _sketches, keep_one, near_duplicates


def shingles(text, n=5):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    comp = {i: i for i, _ in rows if i is not None}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            if a is not None and b is not None and (inter := len(sets[i] & sets[j])) and 100 * inter >= 75 * len(sets[i] | sets[j]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return sorted((i if i is not None else -1, len(s), root(i) if i is not None and s else i) for (i, _), s in zip(rows, sets, strict=True))


def family(rng, size, edits, words_=120):
    vocabulary = np.array([f"w{i}" for i in range(3000)])
    base = rng.choice(vocabulary, words_)
    out = []
    for _ in range(size):
        copy = base.copy()
        copy[rng.integers(0, words_, edits)] = rng.choice(vocabulary, edits)
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    texts = [t for edits in (1, 2, 3, 4, 5) for t in family(rng, 25, edits)]
    # chains: each copy edits the one before
    chain = family(rng, 1, 0)[0].split()
    for _ in range(15):
        chain[rng.integers(0, len(chain))] = f"x{rng.integers(1e6)}"
        texts.append(" ".join(chain))
    texts += ["Same text here"] * 5 + ["same  TEXT\there", "", None, " \n", "é É", "one two three four five", "one two three four five six"]
    order = rng.permutation(len(texts))
    rows = [(int(i), texts[i]) for i in order]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted((r.id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows)


def test_links_off_the_stars(spark):
    """b is like a and like c, a is not like c, and the leaders of the buckets are a and c alone."""
    words_ = [f"w{i}" for i in range(100)]
    a, b, c = list(words_), list(words_), list(words_)
    b[0:9] = [f"b{i}" for i in range(9)]
    c[0:9] = b[0:9]
    c[91:100] = [f"c{i}" for i in range(9)]
    rows = [(5, " ".join(b)), (1, " ".join(a)), (3, " ".join(c))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {1}


def test_edges(spark):
    rows = [(None, "a b c d e f", 1), (2, "a b c d e f", 2), (3, "a b c d e f", 3), (3, "a b c d e f", 3), (4, "x " * 50000, 4), (5, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(((r.id or 0), r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [(0, 2, None, True), (2, 2, 2, True), (3, 2, 2, False), (3, 2, 2, False), (4, 1, 4, True), (5, 0, 5, True)]
    assert near_duplicates(df.limit(0)).count() == 0
    assert sorted(r.doc_id or 0 for r in keep_one(df).collect()) == [0, 2, 4, 5]


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.id: r.component for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == root(x) for x in parent)
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_sketch_estimates():
    rng = np.random.default_rng(4)
    shared, own = mix(rng.integers(0, 1 << 60, 900).astype(np.uint64)), mix(rng.integers(0, 1 << 60, 200).astype(np.uint64))
    s = _sketches(np.array([_samples(np.concatenate((shared, own[:100]))), _samples(np.concatenate((shared, own[100:])))]))
    z = int(np.bitwise_count(s[0] ^ s[1]).sum())
    assert abs(1 + 0.5 * np.log(1 - 2 * z / 512) - 900 / 1100) < 0.12


def test_words_and_spans():
    import pyarrow as pa

    texts = ["Ab c\n D", None, "", "é x y", " a ", "a b c d e f g"]
    got = [w for x in words(pa.array(texts)) for i in range(len(x.rows)) for w in [[bytes(x.data[a:b]).decode() for a, b in zip(x.starts[x.first[i] : x.first[i + 1]], x.ends[x.first[i] : x.first[i + 1]], strict=True)]]]
    assert got == [["ab", "c", "d"], [], [], ["é", "x y"], ["a"], list("abcdefg")]
    h = np.arange(1, 20, dtype=np.uint64)
    s = Spans(h)
    one = lambda *x: np.array(x)
    assert s.without(one(3), one(8), one(5)) == Spans(h[[3, 4, 6, 7]]).of(one(0), one(4))


def test_hot_classes_and_clashing_names(spark):
    """Copies of one text and empty texts in masses; columns named like the helpers."""
    texts = ["the same long text of many words here again"] * 1500 + [""] * 1500 + [f"own text number {i} of some words {i * 3}" for i in range(60)]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, __0 int, component_id string").repartition(4)
    got = {r.id: r for r in near_duplicates(df).collect()}
    assert len(got) == len(texts) and all(got[i].component_id == 0 and got[i].kept == (i == 0) for i in range(1500))
    assert all(got[i].component_id == i and got[i].kept for i in range(1500, 3000))
    assert keep_one(df).columns == df.columns and keep_one(df).count() == len(texts) - 1499
