"""Operator 5: MinHash near-duplicates with odd sketches.

1. Every text becomes its set of word shingles (64-bit hashes), 256 MinHash samples, 32 band keys of 4 samples, and an
   odd sketch: the samples folded into 512 parity bits. Texts of equal sets are one class with its smallest id.
2. Classes that share a band key are candidates. The XOR of two odd sketches has a population count that estimates the
   similarity; hopeless pairs are dropped, the margin is more than four standard deviations.
3. First only stars are verified: each class against the leader of its buckets that looks closest. Then, in ROUNDS
   rounds, classes of one bucket that are still in different components are compared by their sketches, tile
   by tile, and each is verified against the closest of them. That joins nearly all members of a large group in a few
   comparisons a member. What is left - pairs of one bucket, still in different components, that may be similar by a
   finer odd sketch of 1024 samples and 2048 bits too - is verified whole. A pair inside one component needs no check,
   so no group is expanded into all its pairs and no link is lost.
4. Verification counts the intersection of the full sets, which are built again for these documents alone.

A pair at similarity 0.75 shares no band with probability 5e-6. The method is exact otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, arrow_stream, bitmap, free_names, in_bitmap, join_keyed, join_salted, stage
from .graph import components
from .kernels import lists, mix, shingle_sets, words

SAMPLES, BANDS, BITS = 256, 32, 512
ROWS = 4
ROUNDS = 1
#: Estimates that are lower than the threshold by more than this are dropped: over four standard deviations.
SLACK, FINE_SLACK = 0.2, 0.1
FINE_SAMPLES, FINE_BITS = 1024, 2048
TILE = 2048
_rng = np.random.default_rng(20240501)
_A = _rng.integers(0, 1 << 32, FINE_SAMPLES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, FINE_SAMPLES, dtype=np.uint32)
_LONGS = [f"s{i}" for i in range(BITS // 64)]


def _samples(hashes: np.ndarray, count: int = SAMPLES) -> np.ndarray:
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(count, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        part = x[None, at : at + 2048] * _A[:count, None]
        part ^= _B[:count, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def _bands(samples: np.ndarray) -> np.ndarray:
    """(texts, BANDS) keys."""
    s = samples[:, : BANDS * ROWS].reshape(len(samples), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), s.shape[:2]).copy()
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, k])
    return key


def _sketches(samples: np.ndarray, bits: int = BITS) -> np.ndarray:
    """(texts, bits // 64) words of parity bits."""
    number = np.arange(samples.shape[1], dtype=np.uint64) << np.uint64(40)
    bit = (mix(samples.astype(np.uint64) + number) % np.uint64(bits)).astype(np.int64)
    flat = np.bincount((bit + np.arange(len(samples))[:, None] * bits).ravel(), minlength=len(samples) * bits).astype(np.uint64) & np.uint64(1)
    return (flat.reshape(len(samples), bits // 64, 64) << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)


def _worst(similarity: float, samples: int = SAMPLES, bits: int = BITS, slack: float = SLACK) -> int:
    """The largest XOR population count that is kept: that of a similarity lower by ``slack``."""
    differ = 2 * samples * (1 - max(similarity - slack, 0))
    return int(np.ceil(bits / 2 * (1 - (1 - 2 / bits) ** differ)))


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, n_shingles, f1, f2, keys, s0...): one row a document; f1 and f2 identify the set."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = 0
        for w in words(batch.column(1)):
            sizes, prints, samples = [], [], []
            for s in shingle_sets(w, n):
                sizes.append(len(s))
                prints.append((int(mix(s + np.uint64(1)).sum(dtype=np.uint64)), int(mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64))) if len(s) else (0, 0))
                samples.append(_samples(s))
            m = np.array(samples)
            f = np.array(prints, dtype=np.uint64).view(np.int64)
            keys, sketch = _bands(m), _sketches(m)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(sizes)), pa.array(sizes, pa.int64()), pa.array(f[:, 0]), pa.array(f[:, 1]), lists(list(keys), pa.int64()), *[pa.array(np.ascontiguousarray(sketch[:, i]).view(np.int64)) for i in range(BITS // 64)]],
                ["id", "n_shingles", "f1", "f2", "keys", *_LONGS],
            )
            at += len(sizes)

    longs = ", ".join(f"{x} long" for x in _LONGS)
    return arrow_map(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")), run, f"id long, n_shingles long, f1 long, f2 long, keys array<long>, {longs}")


def _again(docs: DataFrame, id_col: str, text_col: str, n: int, wanted: DataFrame, name: str, of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(id, name): ``of`` the shingle sets of the documents whose ids are in ``wanted`` (and of a few others)."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("id").alias("h")), "h"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        mask = in_bitmap(bits.value, batch.column(2).to_numpy())
        batch = batch.filter(pa.array(mask))
        at = 0
        for w in words(batch.column(1)):
            found = [of(s) for s in shingle_sets(w, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(found)), lists(found, pa.int64())], ["id", name])
            at += len(found)

    ids = docs[id_col].cast("long")
    return arrow_map(docs.where(ids.isNotNull()).select(ids.alias("id"), docs[text_col].alias("text"), F.xxhash64(ids).alias("h")), run, f"id long, {name} array<long>")


def _verified(docs: DataFrame, id_col: str, text_col: str, n: int, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets have den * intersection >= num * union."""
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = _again(docs, id_col, text_col, n, wanted, "set", lambda s: s)
    # many may be compared with one b, the smaller id
    joined = join_salted(pairs, sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b", "a").join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    counted = joined.select("a", "b", common.alias("i"), (F.size("sa") + F.size("sb")).alias("t"))
    return counted.where((F.col("i") > 0) & (F.lit(den) * F.col("i") >= F.lit(num) * (F.col("t") - F.col("i")))).select("a", "b").distinct()


def _closest_pairs(rows: DataFrame, worst: int, num: int, den: int) -> DataFrame:
    """(a, b): for each light row a the closest row of one of its buckets and of another component, if its sketch allows the similarity."""

    def compare(light: _Rows, base: _Rows) -> tuple[np.ndarray, ...]:
        z, may = light.against(base, worst, num, den)
        z = np.where(may, z, np.int16(32767))
        x = np.flatnonzero(may.any(axis=1))
        y = z[x].argmin(axis=1)
        return light.ids[x], base.ids[y], z[x, y].astype(np.int32)

    met = _tilewise(rows, compare, "a long, b long, z int")
    return met.groupBy("a").agg(F.min(F.struct("z", "b")).alias("m")).select("a", F.col("m.b").alias("b"))


def _all_pairs(rows: DataFrame, worst: int, num: int, den: int) -> DataFrame:
    """(a, b): all pairs of light rows with rows of one of their buckets and of another component, if both sketches allow the similarity.

    ``rows`` have the band keys and the fine sketches too. A pair is given in the first band that it shares alone.
    """
    fine = _worst(num / den, FINE_SAMPLES, FINE_BITS, FINE_SLACK)

    def compare(light: _Rows, base: _Rows) -> tuple[np.ndarray, ...]:
        x, y = np.nonzero(light.against(base, worst, num, den)[1])
        kept = []
        for at in range(0, len(x), 4096):
            p, q = x[at : at + 4096], y[at : at + 4096]
            band = (light.keys[p] == base.keys[q]).argmax(axis=1)
            ok = light.keys[p, band] == light.key
            # of two light rows each meets the other: one time is enough
            ok &= (base.comp[q] == base.main[q]) | (light.ids[p] > base.ids[q])
            p, q = p[ok], q[ok]
            z = np.bitwise_count(light.fine[p] ^ base.fine[q]).sum(axis=1, dtype=np.int32)
            kept.append((p[z <= fine], q[z <= fine]))
        x, y = (np.concatenate(c) for c in zip(*kept, strict=True)) if kept else (x, y)
        return light.ids[x], base.ids[y]

    return _tilewise(rows, compare, "a long, b long")


class _Rows:
    """Rows of one bucket and tile as arrays."""

    def __init__(self, batch: pa.RecordBatch):
        column = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
        self.key = np.int64(batch.column("key")[0].as_py())
        self.ids, self.comp, self.main, self.size = column("id"), column("comp"), column("main"), column("n_shingles")
        self.sketch = np.stack([column(s).view(np.uint64) for s in _LONGS], axis=1)
        if "fine" in batch.schema.names:
            self.keys, self.fine = (batch.column(c).flatten().to_numpy().reshape(len(self.ids), -1) for c in ("keys", "fine"))
            self.fine = self.fine.view(np.uint64)

    @classmethod
    def joined(cls, parts: list[_Rows]) -> _Rows:
        if len(parts) == 1:
            return parts[0]
        out = cls.__new__(cls)
        out.key = parts[0].key
        for name in vars(parts[0]):
            if name != "key":
                setattr(out, name, np.concatenate([getattr(p, name) for p in parts]))
        return out

    def against(self, base: _Rows, worst: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Population counts of all XORs, and which pairs are of different components and may be similar."""
        z = np.zeros((len(self.ids), len(base.ids)), np.int16)
        for i in range(len(_LONGS)):
            z += np.bitwise_count(self.sketch[:, None, i] ^ base.sketch[None, :, i])
        low, high = np.minimum(self.size[:, None], base.size[None, :]), np.maximum(self.size[:, None], base.size[None, :])
        return z, (z <= worst) & (self.comp[:, None] != base.comp[None, :]) & (den * low >= num * high)


def _tilewise(rows: DataFrame, compare: Callable[[_Rows, _Rows], tuple[np.ndarray, ...]], schema: str) -> DataFrame:
    """``compare`` of light rows with the base rows of their tile.

    Of a tile all base rows (light = false, some TILE of them) are held; light rows stream by in batches, so memory is
    bounded however large the bucket.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, base = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, tile, light = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "tile", "light"))
            cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(tile) != 0) | (np.diff(light.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(key)], strict=True):
                if (key[a], tile[a]) != group:
                    group, held, base = (key[a], tile[a]), [], None
                part = _Rows(batch.slice(a, b - a))
                if not light[a]:
                    held.append(part)
                    base = None
                elif held:
                    base = base or _Rows.joined(held)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in compare(part, base)], names)

    return arrow_stream(rows, run, schema)


def _mixed(shared: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, id, comp, main, tiles): members of buckets of several components; main is the largest of these."""
    placed = shared.select("key", "id").join(comp, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    by_comp = placed.groupBy("key", "comp").count()
    mixed = by_comp.groupBy("key").agg(F.max_by("comp", "count").alias("main"), F.sum("count").alias("members"), F.count("*").alias("comps")).where("comps > 1")
    return placed.join(mixed.select("key", "main", F.ceil(F.col("members") / TILE).cast("int").alias("tiles")), "key")


def _tiles(mixed: DataFrame, thin: DataFrame) -> DataFrame:
    """All members once by tile, and those outside the bucket's main component for each tile."""
    rows = mixed.join(thin, "id")
    columns = ["key", "tile", "light", "comp", "main", *thin.columns]
    base = rows.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).withColumn("light", F.lit(False)).select(columns)
    light = rows.where("comp <> main").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("light", F.lit(True)).select(columns)
    return base.union(light).repartition("key", "tile").sortWithinPartitions("key", "tile", "light")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row: documents with den * intersection >= num * union are linked.

    component_id is the smallest id that links reach, the row's own included. A null or empty text has no set and is
    linked with nothing. Rows with one id are one document. A row without an id is linked with nothing; its component
    is null and it is kept. An empty table gives no rows. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    sigs = stage(spark, signatures(docs, id_col, text_col, n), "signatures")
    classes = sigs.where("n_shingles > 0 and id is not null").groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    # the id is a key of the join, so a class of copies does not meet in one task
    reps = sigs.join(classes, (sigs.f1 == classes.f1) & (sigs.f2 == classes.f2) & (sigs.id == classes.rep)).select("id", "n_shingles", "keys", *_LONGS)
    reps = stage(spark, reps, "classes")
    members = reps.select(F.explode("keys").alias("key"), "id")
    leaders = members.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader <> last").select("key", "leader")
    shared = stage(spark, members.join(leaders, "key"), "buckets")
    thin = reps.select("id", "n_shingles", *_LONGS)
    other = thin.select(*[F.col(c).alias("o_" + c) for c in thin.columns])
    led = stage(spark, shared.where("id <> leader").select("id", "leader").distinct(), "led", narrow=True)
    stars = join_salted(led, other.withColumnRenamed("o_id", "leader"), "leader", "id").join(thin, "id")
    z = sum((F.bit_count(F.col(s).bitwiseXOR(F.col("o_" + s))) for s in _LONGS), F.lit(0))
    sizes = F.lit(den) * F.least("n_shingles", "o_n_shingles") >= F.lit(num) * F.greatest("n_shingles", "o_n_shingles")
    worst = _worst(num / den)
    first = stars.withColumn("z", z).where((F.col("z") <= worst) & sizes).groupBy("id").agg(F.min(F.struct("z", "leader")).alias("m")).select(F.col("id").alias("a"), F.col("m.leader").alias("b"))
    first = stage(spark, first, "stars", narrow=True)
    links = stage(spark, _verified(docs, id_col, text_col, n, first, num, den), "links", narrow=True)
    comp = components(spark, links)
    tested = first.select("a", "b")
    for turn in range(ROUNDS + 1):
        mixed = stage(spark, _mixed(shared, comp), "mixed", narrow=True)
        if turn < ROUNDS:
            met = _closest_pairs(_tiles(mixed, thin), worst, num, den)
        else:
            fine = _again(docs, id_col, text_col, n, mixed.select("id").distinct(), "fine", lambda s: _sketches(_samples(s, FINE_SAMPLES)[None, :], FINE_BITS)[0])
            met = _all_pairs(_tiles(mixed, reps.join(fine, "id")), worst, num, den)
        found = met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
        found = stage(spark, found, "pairs", narrow=True)
        if found.isEmpty():
            continue
        more = stage(spark, _verified(docs, id_col, text_col, n, found, num, den), "links", narrow=True)
        tested = tested.union(found)
        if not more.isEmpty():
            links = links.union(more)
            comp = components(spark, links)
    by_class = classes.join(comp, classes.rep == comp.id, "left").select("f1", "f2", F.coalesce("component", "rep").alias("component_id"), "n")
    by_class = stage(spark, by_class, "class-components", narrow=True)
    alone = (F.col("n_shingles") == 0) | F.col("id").isNull()
    rows = sigs.select("id", "n_shingles", "f1", "f2")
    placed = join_keyed(rows.where(~alone), by_class, ["f1", "f2"], "n").select("id", "n_shingles", "component_id")
    placed = placed.union(rows.where(alone).select("id", "n_shingles", F.col("id").alias("component_id")))
    return placed.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` less the near-duplicates of a document with a smaller id; of repeated rows of one id all or none stay."""
    (name,) = free_names(docs, count=1)
    gone = near_duplicates(docs, id_col, text_col).where(~F.col("kept")).select(F.col("id").alias(name)).distinct()
    return docs.join(gone, docs[id_col].cast("long") == F.col(name), "left_anti")
