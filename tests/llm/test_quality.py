import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from corpuslens.llm.queries import op1_quality
from corpuslens.llm import kernels, quality
from corpuslens.llm.quality import _BUCKET, FEATURES, PAIRS, PASSAGE, Model, encode, fit, keep_good, score

from ..conftest import SF, TINY


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op1_quality(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    tested = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert len(tested) > 80 and np.mean([a == b for a, b in tested]) >= 0.93


def test_gradients():
    rng = np.random.default_rng(8)
    m = Model()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, begin, y = rng.random((9, FEATURES)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])

    def loss():
        s = m.forward(x, begin)[0]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    grads = m.gradients(x, begin, y)
    for k, v in m.p.items():
        at = tuple(rng.integers(0, n) for n in v.shape)
        v[at] += 1e-5
        up = loss()
        v[at] -= 2e-5
        down = loss()
        v[at] += 1e-5
        assert abs((up - down) / 2e-5 - grads[k][at]) < 1e-4, k


def test_passages():
    texts = ["", None, "a b", " ".join(f"w{i}" for i in range(3 * PASSAGE + 1)), " \n", "It It It It"]
    (_, x, begin), = encode(pa.array(texts))
    assert np.diff(begin).tolist() == [1, 1, 1, 4, 1, 1]
    assert not x[0].any() and not x[1].any() and abs((x[begin[3]][:-3] ** 2).sum() - 1) < 1e-4
    # a passage's features do not depend on what stands around it
    (_, alone, _), = encode(pa.array([" ".join(f"w{i}" for i in range(PASSAGE, 2 * PASSAGE)) + " "]))
    assert np.allclose(alone[0], x[begin[3] + 1], atol=1e-6)
    assert x[begin[5]][-3] == 0.75


def test_edges(spark):
    docs = spark.createDataFrame([(1, "good words here", 1), (1, "good words here", 1), (None, None, 2), (3, "", 3), (4, "bad " * 100000, 4)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 0), (4, 1), (None, 1), (9, None)], "doc_id long, quality int")
    model = fit(docs, labels)
    got = score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and got[0].score == got[1].score
    assert score(docs, model).columns == [*docs.columns, "score"]
    assert score(docs.limit(0), fit(docs, labels.limit(0))).count() == 0
    assert keep_good(docs, labels, 0.0).count() == 5 and keep_good(docs, labels, 0.0).columns == docs.columns
    flipped = labels.withColumn("quality", 1 - labels.quality)
    assert [r.score for r in score(docs, fit(docs, labels)).collect()] == [r.score for r in got]
    assert [r.score for r in score(docs, fit(docs, flipped)).collect()] != [r.score for r in got]
    clash = docs.withColumnRenamed("quality", "_score").withColumn("_id", docs.doc_id).withColumn("__0", docs.doc_id)
    assert keep_good(clash, labels, 0.0).count() == 5 and keep_good(clash, labels, 0.0).columns == clash.columns
    with pytest.raises(ValueError, match="column Score"):
        score(docs.withColumnRenamed("quality", "score"), model, score_col="Score")


def brute_features(text):
    """Passage by passage, pair by pair."""
    data = (text or "").encode()
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", lower)]
    out = []
    for at in range(0, max(len(spans), 1), PASSAGE):
        some = spans[at : at + PASSAGE]
        x = np.zeros(FEATURES)
        if some:
            end = spans[at + PASSAGE][0] if at + PASSAGE < len(spans) else len(lower)
            pairs = [(lower[i] << 8) | lower[i + 1] for i in range(some[0][0], end - 1)]
            for p in pairs:
                x[_BUCKET[p]] += 1
            size, most = max(len(pairs), 1), x[:PAIRS].max()
            x[:PAIRS] = np.sqrt(x[:PAIRS] / size)
            own = [lower[a:b] for a, b in some]
            x[PAIRS:] = sum(a == b for a, b in zip(own, own[1:], strict=False)) / len(own), len(own) / PASSAGE, most / size
        out.append(x)
    return np.array(out)


def brute_score(model, text):
    """Gated attention by its formulas, one passage after the other."""
    p, encoded, weights = model.p, [], []
    for x in brute_features(text):
        h = np.tanh(x @ p["W"] + p["b"])
        encoded.append(h)
        weights.append(np.exp(sum(w * np.tanh(h @ v) / (1 + np.exp(-h @ u)) for w, v, u in zip(p["w"], p["V"].T, p["U"].T, strict=True))))
    z = sum(w * h for w, h in zip(weights, encoded, strict=True)) / sum(weights)
    return 1 / (1 + np.exp(-(z @ p["c"] + p["d"][0])))


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{TINY}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in op1_quality(spark, TINY).collect()}
    assert got.keys() == texts.keys()
    for k, text in texts.items():
        assert abs(got[k].score - brute_score(model, text)) < 2e-4, k


def test_every_passage_of_the_sample_is_learned_from(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Model, "fit", lambda self, bags, y: seen.append((bags, y)) or self)
    monkeypatch.setattr(quality, "PIECE", 4)
    texts = {i: " ".join(f"w{i}x{k}" for k in range(i * 40)) for i in range(30)}
    docs = spark.createDataFrame([*texts.items(), (3, texts[3])], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    fit(docs, labels)
    learned = [i for i in range(30) if zlib.crc32(str(i).encode()) % 4 != 2]
    (bags, y), = seen
    want = [brute_features(texts[i]) for i in learned]
    assert sorted(map(len, bags)) == sorted(map(len, want)) and len(y) == len(bags)
    for x, label in zip(bags, y, strict=True):
        assert any(len(x) == len(w) and np.allclose(x, w, atol=1e-5) and label == i % 2 for i, w in zip(learned, want, strict=True))
    # a bound on passages drops whole documents, never passages
    fit(docs, labels, bound=60)
    assert 30 < sum(map(len, seen[1][0])) <= 60 and {len(b) for b in seen[1][0]} <= set(map(len, want))
    assert fit(docs, labels, bound=0) and len(seen) == 2


def test_words_of_megabytes(monkeypatch):
    text = "ab " * 40 + "x" * 5000 + " " + "yz" * 700 + " end " + "q " * 100
    (_, whole, _), = encode(pa.array([text]))
    monkeypatch.setattr(kernels, "CHUNK", 256)
    monkeypatch.setattr(quality, "CHUNK", 256)
    (_, pieces, _), = encode(pa.array([text]))
    assert np.allclose(whole, pieces, atol=1e-6) and np.allclose(whole, brute_features(text), atol=1e-5)
    w, = kernels.words(pa.array([text]))
    monkeypatch.undo()
    v, = kernels.words(pa.array([text]))
    assert w.hashes.tolist() == v.hashes.tolist() and len(set(v.hashes.tolist())) == 5
