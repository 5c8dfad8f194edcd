import re
from collections import Counter

import numpy as np

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import lines
from corpuslens.llm.kernels import words
from corpuslens.llm.lines import NEAR_WORDS, _sketches, drop_duplicate_lines, duplicate_lines, within, within_one

from ..conftest import TINY


def split(text):
    return [tuple(w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)) if w) for line in (text or "").split("\n")]


def brute(rows, words_per_edit=None, near_words=NEAR_WORDS):
    """Distinct lines with their earliest places; then all pairs of equal or nearly equal length. Far lines are (id, line, None)."""
    first, out, by_size = {}, set(), {}
    for place, line in sorted({((i, k), line) for i, t in rows if i is not None for k, line in enumerate(split(t)) if line}):
        if line in first:
            out.add((*place, *first[line], 0))
        else:
            first[line] = place
    for line in first:
        by_size.setdefault(len(line), []).append(line)
    for line, place in first.items():
        if len(line) < near_words:
            continue
        near = [first[x] for n in (len(line) - 1, len(line), len(line) + 1) if n >= near_words for x in by_size.get(n, ()) if x != line and first[x] < place and within_one(line, x)]
        if near:
            out.add((*place, 1))
        elif words_per_edit and len(line) >= 2 * words_per_edit - 2:
            bound = len(line) // (words_per_edit - 1)
            earlier = [x for n in range(len(line) - bound, len(line) + bound + 1) for x in by_size.get(n, ()) if first[x] < place and sum((Counter(x) - Counter(line)).values()) <= bound]
            if any(within(line, x, max(len(line), len(x)) // words_per_edit) is not None for x in earlier):
                out.add((*place, None))
    return out


def shape(rows):
    return {(r.id, r.line, r.keep_id, r.keep_line, 0) if r.distance == 0 else (r.id, r.line, 1) for r in rows}


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    got = duplicate_lines(docs).collect()
    assert shape(got) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.distance for r in got} == {0, 1} and len({(r.id, r.line) for r in got}) == len(got)


def test_edits_against_brute_force(spark):
    rng = np.random.default_rng(5)
    lines = []
    for _ in range(60):
        base = [f"w{i}" for i in rng.integers(0, 40, rng.integers(4, 14))]
        lines.append(base)
        for _ in range(4):
            x = list(base)
            for _ in range(rng.integers(1, 3)):
                k, at = rng.integers(3), rng.integers(len(x))
                x[at : at + (k > 0)] = [] if k == 1 else [f"w{rng.integers(40)}"]
            lines.append(x)
    rng.shuffle(lines)
    rows = [(i, "\n".join(" ".join(x) for x in lines[i * 5 : i * 5 + 5])) for i in range(len(lines) // 5)]
    got = duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert shape(got) == brute(rows)
    texts = dict(rows)
    for r in got:
        a, b = split(texts[r.id])[r.line], split(texts[r.keep_id])[r.keep_line]
        assert (r.keep_id, r.keep_line) < (r.id, r.line) and within_one(a, b) and (a == b) == (r.distance == 0)


def test_places_of_any_id(spark):
    rows = [(-5, "a b c d e f g"), (1 << 60, "a b c d e f h"), (3, "A b c d e f g")]
    assert shape(duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute(rows) == {(3, 0, -5, 0, 0), (1 << 60, 0, 1)}


def test_edges(spark):
    rows = [(1, "Hello there\n\nhello  THERE\n", "en", 7), (None, "Hello there", "x", 1), (2, "hello there", None, 11), (3, None, "y", None), (4, "", "z", 0), (5, "\n\n", "z", 2), (6, "own\nHello there", "z", 5), (6, "own\nHello there", "z", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, line string, n_chars long")
    assert shape(duplicate_lines(df).collect()) == {(1, 2, 1, 0, 0), (2, 0, 1, 0, 0), (6, 1, 1, 0, 0)}
    out = sorted(((r.doc_id or 0), r.text, r.n_chars) for r in drop_duplicate_lines(df).collect() if r.text is not None)
    assert out == [(0, "Hello there", 11), (1, "Hello there\n\n", 13), (4, "", 0), (5, "\n\n", 2), (6, "own", 3), (6, "own", 3)]
    assert [r.doc_id for r in drop_duplicate_lines(df).collect() if r.text is None] == [3]
    assert drop_duplicate_lines(df).columns == df.columns
    clash = df.withColumnRenamed("line", "_gone").withColumn("_gone_id", F.lit(1)).withColumn("__0", F.lit(2))
    assert drop_duplicate_lines(clash).columns == clash.columns and drop_duplicate_lines(clash).count() == len(out) + 1
    assert duplicate_lines(df.limit(0)).count() == 0 and drop_duplicate_lines(df.limit(0)).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j - 1] + (x != y), row[j] + 1, now[-1] + 1))
        row = now
    return row[-1]


def test_within_against_textbook():
    rng = np.random.default_rng(9)
    for _ in range(300):
        a = list(rng.integers(0, 3, rng.integers(0, 12)))
        b = list(rng.integers(0, 3, rng.integers(0, 12))) if rng.random() < 0.5 else [x for x in a if rng.random() < 0.8]
        for bound in range(6):
            assert within(a, b, bound) == (edits(a, b) if edits(a, b) <= bound else None)


def test_long_lines_bear_more_edits(spark):
    rng = np.random.default_rng(10)
    lines = []
    for n in (38, 39, 40, 41, 59, 60, 61, 90, 130, 205):
        base = [f"w{i}" for i in rng.integers(0, 300, n)]
        lines.append(base)
        for _ in range(6):
            x = list(base)
            for _ in range(rng.integers(1, n // 20 + 3)):
                k, at = rng.integers(3), rng.integers(len(x))
                x[at : at + (k > 0)] = [] if k == 1 else [f"w{rng.integers(300)}"]
            lines.append(x)
        even = list(base)
        for at in range(n // (n // 20 + 1), n, n // (n // 20 + 1) + 1)[: n // 20]:  # as far apart as can be
            even[at] = "even"
        lines.append(even)
    order = rng.permutation(len(lines))
    rows = [(i, " ".join(lines[k])) for i, k in enumerate(order)]
    texts = [split(t)[0] for _, t in rows]
    want = {i for i, x in enumerate(texts) if any(edits(x, y) <= max(1, max(len(x), len(y)) // 20) for y in texts[:i])}
    got = duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words_per_edit=20).collect()
    assert {r.id for r in got} == want and len(got) == len(want)
    assert max(r.distance for r in got) > 3
    for r in got:
        assert r.keep_id < r.id and edits(texts[r.id], texts[r.keep_id]) == r.distance


def far_shape(rows):
    return {(r.id, r.line, r.keep_id, r.keep_line, 0) if r.distance == 0 else (r.id, r.line, 1 if r.distance == 1 else None) for r in rows}


def test_growing_bound_on_documents(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    got = duplicate_lines(docs, words_per_edit=20).collect()
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 20)
    assert far_shape(got) == want and len({(r.id, r.line) for r in got}) == len(got)


def test_short_lines_by_parameter(spark):
    rows = [(1, "one two three four"), (2, "one two tree four"), (3, "one two four"), (4, "five"), (5, "six")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert duplicate_lines(df).count() == 0
    assert shape(duplicate_lines(df, near_words=3).collect()) == brute(rows, near_words=3) == {(2, 0, 1), (3, 0, 1)}


@pytest.mark.parametrize("spread", [0, 1])
def test_a_passage_of_many_unlike_lines(spark, spread):
    """A passage that all lines hold, at the same place or at many; copies of some lines are edited here and there."""
    rng = np.random.default_rng(11 + spread)
    passage = [f"p{i}" for i in range(50)]
    lines = []
    for k in range(300):
        head = [f"w{i}" for i in rng.integers(0, 5000, rng.integers(0, 40) if spread else 20)]
        tail = [f"w{i}" for i in rng.integers(0, 5000, rng.integers(0, 40) if spread else 30)]
        line = head + passage + tail
        lines.append(line)
        if k % 5 == 0:
            for _ in range(3):
                x = list(line)
                for at in rng.integers(0, len(x), rng.integers(1, 8)):
                    x[at] = f"e{rng.integers(10**6)}"
                lines.append(x)
    order = rng.permutation(len(lines))
    rows = [(i, " ".join(lines[k])) for i, k in enumerate(order)]
    got = duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words_per_edit=20).collect()
    assert {(r.id, 1 if r.distance == 1 else None) for r in got} == {(x[0], x[2]) for x in brute(rows, 20)}
    assert {r.distance for r in got} >= {2, 3, 4}


def test_sketches_count_words():
    """A phrase that is repeated an even number of times is not the same as any other that is."""
    w = next(words(pa.array(["a b c d " * 10, "e f g h " * 10, "a b c d " * 9 + "a b c x"])))
    s = _sketches(w, np.arange(3)).view(np.uint64)
    odd = [[int(np.bitwise_count(x ^ y).sum()) for y in s] for x in s]
    assert odd[0][1] > 60 and odd[0][2] <= 2


@pytest.fixture
def staged(monkeypatch):
    """What duplicate_lines writes, by label."""
    seen, write = {}, lines.stage

    def spy(spark, df, label, **options):
        seen[label] = write(spark, df, label, **options)
        return seen[label]

    monkeypatch.setattr(lines, "stage", spy)
    return seen


def test_words_are_read_for_pairs_alone(spark, staged):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, passage + " " + " ".join(f"w{i}x{k}" for k in range(30))) for i in range(20)]
    assert duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string"), words_per_edit=20).count() == 0
    assert all(df.count() == 0 for label, df in staged.items() if label != "neighbourhoods" and {"words", "x"} & set(df.columns))


def test_pairs_are_compared_once(spark, staged):
    """Copies in which other words have moved: their bags are equal, their distances beyond the bound."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(40):
        x = [f"w{k}" for k in range(100)]
        for _ in range(rng.integers(1, 5)):
            x.insert(rng.integers(99), x.pop(rng.integers(100)))
        rows.append((i, " ".join(x)))
    got = duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string"), words_per_edit=20).collect()
    assert {(r.id, 1 if r.distance == 1 else None) for r in got} == {(x[0], x[2]) for x in brute(rows, 20)}
    pairs = [{(r["at"], r["keep"]) for r in staged[label].collect()} for label in ("led-alike", "met")]
    assert pairs[0] and pairs[1] and not pairs[0] & pairs[1]


def test_variants_of_the_other_half_alone(spark, staged):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f x h"), (3, "q a b c r s t u"), (4, "v a b c r s t u"), (5, "b c e f g h i"), (6, "b c e z f g h i")]
    got = duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert shape(got) == brute(rows) == {(2, 0, 1), (4, 0, 1), (6, 0, 1)}
    assert all(len(r.variants) <= len(r.words) // 2 + 1 for r in staged["neighbourhoods"].collect())
