import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpuslens.llm.kernels import PUNCTUATION, words
from corpuslens.llm.leaks import THRESHOLD, align, drop_leaks, find_leaks

from ..conftest import TINY


def hashes(texts):
    return [w.hashes[w.first[i] : w.first[i + 1]] for w in words(pc.utf8_lower(pa.array(texts, pa.string())), PUNCTUATION) for i in range(len(w.rows))]


def smith_waterman(a, b):
    h, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best


def test_align_against_textbook():
    rng = np.random.default_rng(6)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 20))
        best, end = align(a, b)
        assert best == smith_waterman(a, b) == align(a, b[:end])[0]


def test_documents_against_brute_force(spark):
    docs, items = spark.read.parquet(f"{TINY}/documents.parquet"), spark.read.parquet(f"{TINY}/benchmark.parquet")
    d, b = docs.collect(), items.collect()
    want = {}
    tests = hashes([r.text for r in b])
    for row, text in zip(d, hashes([r.text for r in d]), strict=True):
        for item, test in zip(b, tests, strict=True):
            score = align(test, text)[0] / (2 * len(test))
            if score >= THRESHOLD:
                want[row.doc_id, item.item_id] = score
    got = {(r.doc, r.item): r.score for r in find_leaks(docs, items).collect()}
    assert got == want and len(want) >= 3


def test_edited_copies(spark):
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(15, 60)))) for i in range(20)]
    rows, want = [], set()
    for k in range(200):
        text = list(rng.choice(vocabulary, 80))
        if k % 2:
            i, passage = items[k % 20]
            passage = passage.split()
            for at in rng.integers(0, len(passage), len(passage) // 8):  # an eighth of the words edited
                passage[at] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                del passage[rng.integers(len(passage))]
            text[40:40] = [w.title() + "," for w in passage]
            want.add((k, i))
        rows.append((k, " ".join(text)))
    docs, tests = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc, r.item) for r in find_leaks(docs, tests).collect()} == want
    assert sorted(r.doc_id for r in drop_leaks(docs, tests).collect()) == sorted({r[0] for r in rows} - {k for k, _ in want})


def test_edges(spark):
    passage = "the quick brown fox jumps over the lazy dog near the river bank"
    items = spark.createDataFrame([(1, passage), (1, passage), (2, None), (3, ""), (4, "two words"), (None, passage)], "item_id long, text string")
    accents = "où ça mène élève être naïf garçon forêt château œuvre été"
    shouted = spark.createDataFrame([(9, "xx " + accents.upper())], "doc_id long, text string")
    assert find_leaks(shouted, spark.createDataFrame([(7, accents)], "item_id long, text string")).first().score == 1.0
    rows = [(1, passage.upper() + "!", 0), (1, passage, 0), (2, None, 1), (None, passage, 2), (3, "", 3), (4, "two words", 4), (5, "a " * 50000 + passage, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item int")
    assert {(r.doc, r.item) for r in find_leaks(docs, items).collect()} == {(1, 1), (4, 4), (5, 1)}
    hot = spark.createDataFrame([(i, "just two words" if i % 2 else "Two, words!") for i in range(3000)], "doc_id long, text string")
    assert sorted(r.doc for r in find_leaks(hot, items).collect()) == list(range(0, 3000, 2))
    assert drop_leaks(docs, items).columns == docs.columns
    assert find_leaks(docs.limit(0), items).count() == 0 and find_leaks(docs, items.limit(0)).count() == 0


def test_dense_edits_and_many_copies(spark):
    rng = np.random.default_rng(8)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 400, rng.integers(15, 60)))) for i in range(12)]
    edits = {
        0: lambda w: [f"x{rng.integers(10**6)}" if i % 4 == 3 else x for i, x in enumerate(w)],
        1: lambda w: [y for i, x in enumerate(w) for y in ([x, f"x{rng.integers(10**6)}"] if i % 3 == 2 else [x])],
        2: lambda w: [y for i, x in enumerate(w) for y in ([x, f"x{rng.integers(10**6)}"] if i % 2 else [x])],
        3: lambda w: [f"x{rng.integers(10**6)}" if i % 3 == 2 else x for i, x in enumerate(w)],
    }
    rows = [(1000 * kind + 20 * i + copy, " ".join(edit(text.split()))) for kind, edit in edits.items() for i, text in items for copy in range(20)]
    want = {}
    tests = hashes([t for _, t in items])
    for (key, _), text in zip(rows, hashes([t for _, t in rows]), strict=True):
        for (i, _), test in zip(items, tests, strict=True):
            score = align(test, text)[0] / (2 * len(test))
            if score >= THRESHOLD:
                want[key, i] = score
    assert {k for k, _ in want} >= {k for k, _ in rows if k < 3000} and any(k >= 3000 for k, _ in want)
    docs, tests = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc, r.item): r.score for r in find_leaks(docs, tests).collect()} == want


def test_a_phrase_of_all_documents_and_pieces(spark, monkeypatch):
    """A frequent seed joins what it must; seeds of long texts are hashed in pieces."""
    from corpuslens.llm import leaks

    monkeypatch.setattr(leaks, "PIECE", 7)
    phrase = "as a matter of fact"
    items = spark.createDataFrame([(i, f"{phrase} question {i} asks for number {i * 31} of them all") for i in range(6)], "item_id long, text string")
    texts = {r.item_id: r.text for r in items.collect()}
    rows = [(k, f"{phrase} word{k} other{k * 7} {phrase} more{k}" + (f" {texts[k % 6]}" if k % 50 == 0 else "")) for k in range(3000)]
    got = {(r.doc, r.item) for r in find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    whole = {(k, i) for k in range(0, 3000, 50) for i in [k % 6]}
    tests = dict(zip(texts, hashes(list(texts.values())), strict=True))
    some = [r for r in rows if r[0] % 25 == 0]
    want = {(k, i) for (k, _), h in zip(some, hashes([t for _, t in some]), strict=True) for i, test in tests.items() if align(test, h)[0] >= len(test)}
    assert whole <= want and {(k, i) for k, i in got if k % 25 == 0} == want
