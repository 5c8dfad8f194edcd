"""Operator 1: quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is encoded: the square roots of its byte-pair
frequencies (hashed to PAIRS), with three numbers on its shape, go through a learned layer. Gated attention (Ilse et al., 2018) weights the passages,
and the weighted representation is scored. All layers are learned from document labels alone.

Fitting takes a bounded sample of labelled documents: those with the smallest id hashes, at most SAMPLE, and as many of
them as have BOUND passages together; every passage of a sampled document is used. Fitting runs on the driver, whose
memory it needs (about 1 KB a passage) does not depend on the corpus. Scoring reads every passage of every text. Labels,
language, source and id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, free_names, stage
from .kernels import CHUNK, mix, words

PASSAGE, PAIRS, HIDDEN, GATE = 64, 256, 32, 16
FEATURES = PAIRS + 3
SAMPLE, BOUND, EPOCHS, RATE = 4000, 100_000, 30, 0.004
#: Passages that are encoded at once, and of one row of the encoded sample.
PIECE = 1024
#: Small samples are passed over more often, for so many updates at least.
UPDATES = 1000
_BUCKET = (mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(99)) % np.uint64(PAIRS)).astype(np.int64)


def held_out(id_col: str) -> Column:
    """Documents that are never learned from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def encode(column: pa.Array) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """Rows, passage features and where each row's passages begin. A text without words is one passage of zeros."""
    for w in words(column):
        count = np.diff(w.first)
        passages = np.maximum(-(-count // PASSAGE), 1)
        begin = np.concatenate(([0], np.cumsum(passages)))
        inside = np.arange(begin[-1]) - np.repeat(begin[:-1], passages)
        word = np.repeat(w.first[:-1], passages) + inside * PASSAGE
        full = np.repeat(count > 0, passages)
        # bytes of a passage: from its first word to the next passage's first word, or the text's end
        starts = w.starts[np.minimum(word, max(len(w.starts) - 1, 0))] if len(w.starts) else np.zeros(len(word), np.int64)
        ends = np.append(starts[1:], 0)
        last = begin[1:] - 1
        ends[last] = w.offsets[1:]
        size = np.where(full, np.maximum(ends - starts - 1, 0), 0)
        # shape: words that repeat the one before, words of the passage, share of the fullest byte pair
        first, held = np.minimum(word, len(w.starts)), np.where(full, np.minimum(np.repeat(w.first[1:], passages) - word, PASSAGE), 0)
        again = np.zeros(len(w.starts) + 1)
        if len(w.starts) > 1:
            np.cumsum(w.hashes[1:] == w.hashes[:-1], out=again[2:])
        repeats = again[np.where(held > 0, first + held, 0)] - again[np.where(held > 0, first + 1, 0)]
        x = np.empty((len(size), FEATURES), np.float32)
        for at in range(0, len(size), PIECE):
            part = slice(at, at + PIECE)
            counts = _pair_counts(w.data, starts[part], size[part])
            most = np.maximum(size[part], 1)
            x[part, :PAIRS] = np.sqrt(counts / most[:, None])
            x[part, PAIRS:] = np.stack((repeats[part] / np.maximum(held[part], 1), held[part] / PASSAGE, counts.max(axis=1) / most), axis=1)
        yield w.rows, x, begin


def _pair_counts(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(passages, PAIRS): hashed byte pairs of the bytes from each start."""
    out = np.zeros((len(size), PAIRS), np.int64)
    small = size <= CHUNK
    at = np.repeat((starts - np.concatenate(([0], np.cumsum(size * small)[:-1])))[small], size[small]) + np.arange((size * small).sum())
    if len(at):
        pair = (data[at].astype(np.int64) << 8) | data[at + 1]
        out += np.bincount(np.repeat(np.arange(len(size)), size * small) * PAIRS + _BUCKET[pair], minlength=len(size) * PAIRS).reshape(out.shape)
    for i in np.flatnonzero(~small):  # a passage of words of megabytes, counted piece by piece
        for a in range(starts[i], starts[i] + size[i], CHUNK):
            b = min(a + CHUNK, starts[i] + size[i])
            out[i] += np.bincount(_BUCKET[(data[a:b].astype(np.int64) << 8) | data[a + 1 : b + 1]], minlength=PAIRS)
    return out


class Model:
    """Encoder, gated attention and score, with their gradients."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        scale = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"W": scale(FEATURES, HIDDEN) * 3, "b": np.zeros(HIDDEN, np.float32), "V": scale(HIDDEN, GATE), "U": scale(HIDDEN, GATE), "w": scale(GATE), "c": scale(HIDDEN), "d": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, tuple]:
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        n = np.diff(begin)
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, begin[:-1]), n))
        a /= np.repeat(np.add.reduceat(a, begin[:-1]), n)
        z = np.add.reduceat(a[:, None] * h, begin[:-1], axis=0)
        logit = z @ p["c"] + p["d"][0]
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40).astype(float))), (h, t, g, a, z, n)

    def gradients(self, x: np.ndarray, begin: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        s, (h, t, g, a, z, n) = self.forward(x, begin)
        dlogit = ((s - y) / len(y)).astype(np.float32)
        dz = np.repeat(dlogit[:, None] * p["c"], n, axis=0)
        da = (dz * h).sum(axis=1)
        mean = np.repeat(np.add.reduceat(a * da, begin[:-1]), n)
        de = a * (da - mean)
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ dlogit, "d": dlogit.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, batch: int = 64, decay: float = 3e-4) -> Model:
        """Adam over the bags; the same bags in the same order give the same model."""
        rng = np.random.default_rng(2)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        for _ in range(max(epochs, -(-UPDATES // -(-len(bags) // batch)))):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                begin = np.concatenate(([0], np.cumsum([len(bags[i]) for i in some])))
                grads = self.gradients(np.concatenate([bags[i] for i in some], dtype=np.float32), begin, y[some])
                step += 1
                for k, grad in grads.items():
                    grad = grad + decay * self.p[k]
                    first[k] += 0.1 * (grad - first[k])
                    second[k] += 0.01 * (grad * grad - second[k])
                    self.p[k] = (self.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, bound: int = BOUND) -> Model:
    """A model of ``labels`` (0 or 1) on documents that are not held out. Ids with both labels or none are not used.

    Unlike texts of one id are a bag each, equal ones one bag. Without any labelled document the model is the untrained one.
    """
    spark = docs.sparkSession
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(id_col).agg(F.min(label_col).alias("y"), F.max(label_col).alias("y2")).where("y = y2")
    # at most ``sample`` rows, so the broadcast is bounded
    drawn = F.broadcast(ids.orderBy(F.xxhash64(id_col), id_col).limit(sample).select(F.col(id_col).alias("known"), F.xxhash64(id_col).alias("place"), F.col("y").cast("int").alias("y")))
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    text = texts.join(drawn, texts["id"] == drawn["known"]).select("place", F.xxhash64("text").alias("print"), "y", "text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for rows, x, begin in encode(batch.column(3)):
            for i, row in enumerate(rows):
                for at in range(begin[i], begin[i + 1], PIECE):
                    piece = x[at : min(at + PIECE, begin[i + 1])]
                    yield pa.RecordBatch.from_arrays([*(c.slice(row, 1) for c in batch.columns[:3]), pa.array([int(at - begin[i])], pa.int64()), pa.array([len(piece)], pa.int64()), pa.array([piece.tobytes()], pa.binary())], ["place", "print", "y", "at", "passages", "x"])

    encoded = stage(spark, arrow_map(text, run, "place long, print long, y int, at long, passages long, x binary"), "sample")
    pieces = encoded.dropDuplicates(["place", "print", "at"])
    sizes = pieces.groupBy("place", "print").agg(F.sum("passages").alias("passages")).orderBy("place", "print").toArrow()
    last = int(np.searchsorted(np.cumsum(sizes["passages"].to_numpy()), bound, "right")) - 1
    if last < 0:
        return Model()
    end = F.struct(*[F.lit(sizes[c][last].as_py()) for c in ("place", "print")])
    got = pieces.where(F.struct("place", "print") <= end).toArrow().sort_by([(c, "ascending") for c in ("place", "print", "at")])
    begin = np.flatnonzero(got["at"].to_numpy() == 0)
    x = [np.frombuffer(b.as_buffer(), np.float32).reshape(-1, FEATURES) for c in got["x"].chunks for b in c]
    bags = [np.concatenate(x[a:b]) if b - a > 1 else x[a] for a, b in zip(begin, np.append(begin[1:], len(x)), strict=True)]
    return Model().fit(bags, got["y"].to_numpy()[begin].astype(np.float32))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``: 0 to 1 from every passage of the whole text, null and empty texts included.

    Other columns pass unchanged; a column of the name ``score_col`` is an error.
    """
    if score_col.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"the table has a column {score_col}")
    at = docs.columns.index(text_col)
    known = docs.sparkSession.sparkContext.broadcast(model.p)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        local = Model.__new__(Model)
        local.p = known.value
        scores = [local.forward(x, begin)[0] for _, x, begin in encode(batch.column(at))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())], [*batch.schema.names, score_col])

    return arrow_map(docs, run, _with(docs, score_col))


def _with(docs: DataFrame, name: str):
    from pyspark.sql.types import DoubleType, StructField, StructType

    return StructType([*docs.schema.fields, StructField(name, DoubleType())])


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, text_col: str = "text", **options) -> DataFrame:
    """Those of ``docs`` that score ``threshold`` or more."""
    (name,) = free_names(docs, count=1)
    scored = score(docs, fit(docs, labels, text_col=text_col, **options), text_col, name)
    return scored.where(F.col(name) >= threshold).drop(name)
