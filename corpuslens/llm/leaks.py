"""Operator 3: benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

1. Seeds are all runs of n words of the test items, and all runs of n + 1 words, also those in which one word is put in,
   left out or changed: of both sides the runs of n + 1 words out of n + 2 (one inner word skipped) are hashed too.
2. Documents are searched for seeds; around the hits the word hashes are cut out (as far as an alignment that reaches the
   threshold can go, overlapping cuts are one region), and seeds join regions to items.
3. Pairs stay whose region holds enough words of the item close together; no pair that reaches the threshold goes here.
4. A local alignment of the item with the region (match 2, mismatch and gap -1) is scored against the item's best
   possible score. From THRESHOLD on the document leaks the item.

A copy is found if n words in a row are intact anywhere, or n + 1 with one edit inside. At the threshold of 0.5 and n = 3
copies without either score at most about 2/3 (a word put in after the second, third, fifth, sixth, ... word); these may
be missed.

No seed is left out for being frequent, as at the threshold any may be the only one that an edited copy shares; frequent
seeds and items are spread over tasks instead.

Words are runs of letters, digits and non-ASCII characters in lower case; ASCII punctuation parts words and is not compared.
An item of under n words has no n-gram; it is leaked by documents that have just its words.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bitmap, in_bitmap, join_salted, stage
from .kernels import PUNCTUATION, Words, lists, mix, words

SEED_WORDS = 3
THRESHOLD = 0.5
#: Runs that are hashed at once.
PIECE = 1 << 18
_STEP = np.uint64(0xD6E8FEB86659FD93)


def seed_hits(w: Words, n: int, keep: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, text, gram): first word, text and hash of all seeds of a chunk, or of those that ``keep`` marks, ordered by word.

    Seeds are n words in a row, n + 1 in a row, and n + 1 of n + 2 with an inner one skipped.
    """
    forms = [tuple(range(n)), tuple(range(n + 1)), *(tuple(i for i in range(n + 2) if i != k) for k in range(1, n + 1))]
    h, count = w.hashes, np.diff(w.first)
    text = np.repeat(np.arange(len(count)), count)
    at, grams = [], []
    for form in forms:
        m = len(h) - form[-1]
        for low in range(0, m, PIECE):  # of long texts only the seeds that are kept are held
            high = min(low + PIECE, m)
            g = np.zeros(high - low, np.uint64)
            for k in form:
                g = g * _STEP + h[k + low : k + high]
            g = mix(g + np.uint64(len(form)))
            inside = text[low:high] == text[form[-1] + low : form[-1] + high]
            if keep is not None:
                inside &= keep(g)
            inside = np.flatnonzero(inside)
            at.append(inside + low)
            grams.append(g[inside])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = np.concatenate(at)
    order = np.argsort(word, kind="stable")
    return word[order], text[word[order]], np.concatenate(grams)[order]


def reach_of(longest: int, threshold: float) -> int:
    """Words that the text side of an alignment from ``threshold`` on spans at most: the item's, and as many gaps as the score allows."""
    return max(longest, math.ceil(longest * (3 - 2 * threshold)))


def item_grams(items: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(item, words, grams): word hashes of each item, in order, and its distinct seeds."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = 0
        for w in words(pc.utf8_lower(batch.column(1)), PUNCTUATION):
            _, text, g = seed_hits(w, n)
            count = len(w.first) - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, count), lists([w.hashes[w.first[i] : w.first[i + 1]] for i in range(count)], pa.int64()), lists([np.unique(g[text == i]) for i in range(count)], pa.int64())], ["item", "words", "grams"]
            )
            at += count

    return arrow_map(items.where(items[id_col].isNotNull()).select(items[id_col].cast("long").alias("item"), items[text_col].alias("text")), run, "item long, words array<long>, grams array<long>")


def _regions(docs: DataFrame, id_col: str, text_col: str, n: int, seeds: DataFrame, reach: int) -> DataFrame:
    """(doc, start, words, hits): stretches of word hashes around seeds, and the distinct seeds in each."""
    # two bitmaps of other bits of the hash: foreign grams would make regions of their own
    upper = seeds.select(F.shiftrightunsigned("gram", 32).alias("gram"))
    bits = docs.sparkSession.sparkContext.broadcast((bitmap(seeds, "gram"), bitmap(upper, "gram")))

    def known(g: np.ndarray) -> np.ndarray:
        mask = in_bitmap(bits.value[0], g)
        mask[mask] = in_bitmap(bits.value[1], g[mask] >> np.uint64(32))
        return mask

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = 0
        for w in words(pc.utf8_lower(batch.column(1)), PUNCTUATION):
            word, text, g = seed_hits(w, n, known)
            cut = np.flatnonzero((np.diff(text) != 0) | (np.diff(word) > 2 * reach)) + 1 if len(g) else []
            rows: list[list] = [[], [], [], []]
            for a, b in zip(np.concatenate(([0], cut)).astype(int), np.append(cut, len(g)).astype(int), strict=True):
                if a == b:
                    continue
                low, high = w.first[text[a]], w.first[text[a] + 1]
                begin, end = max(low, word[a] - reach), min(high, word[b - 1] + n + 2 + reach)
                for column, value in zip(rows, (at + text[a], begin - low, w.hashes[begin:end], np.unique(g[a:b])), strict=True):
                    column.append(value)
            if rows[0]:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0])), pa.array(rows[1], pa.int64()), lists(rows[2], pa.int64()), lists(rows[3], pa.int64())], ["doc", "start", "words", "hits"])
            at += len(w.first) - 1

    ids = docs[id_col].cast("long")
    return arrow_map(docs.where(ids.isNotNull()).select(ids.alias("doc"), docs[text_col].alias("text")), run, "doc long, start long, words array<long>, hits array<long>")


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local alignment of two word sequences: score (match 2, mismatch and gap -1) and the text position after it."""
    if not len(item) or not len(text):
        return 0, 0
    row, column = np.zeros(len(text) + 1, np.int64), np.arange(len(text) + 1)
    best, end = 0, 0
    for word in item:
        step = np.where(text == word, 2, -1)
        now = np.zeros(len(text) + 1, np.int64)
        np.maximum(row[:-1] + step, row[1:] - 1, out=now[1:])
        np.maximum(now, 0, out=now)
        row = np.maximum.accumulate(now + column) - column  # gaps along the text
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def may_leak(item: np.ndarray, text: np.ndarray, threshold: float) -> bool:
    """False only if no alignment reaches ``threshold``: too few words of the item in every stretch that one can span."""
    known = np.sort(item)
    at = np.minimum(np.searchsorted(known, text), len(known) - 1)
    total = np.concatenate(([0], np.cumsum(known[at] == text)))
    span = min(reach_of(len(item), threshold), len(text))
    return bool((total[span:] - total[: len(total) - span]).max() >= threshold * len(item))


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = SEED_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc, item, score, start, end): leaked items by document; score in [threshold, 1].

    start and end are word offsets: the region searched begins at start, the alignment ends before end. A pair is given
    once, with its best score. Null ids and null or empty texts match nothing; repeated rows are one document; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    every = stage(spark, item_grams(items, item_id, item_text, n), "items")
    tests, short = every.where(F.size("grams") > 0), every.where((F.size("grams") == 0) & (F.size("words") > 0))
    seeds = stage(spark, tests.select("item", F.explode("grams").alias("gram")), "seeds")
    longest = tests.agg(F.max(F.size("words"))).first()[0] or 0
    reach = reach_of(longest, threshold)
    regions = stage(spark, _regions(docs, doc_id, doc_text, n, seeds.select("gram").distinct(), reach), "regions")
    met = join_salted(regions.select("doc", "start", F.explode("hits").alias("gram")), seeds, "gram", "doc").select("doc", "start", "item").distinct()
    met = stage(spark, met, "met", narrow=True)
    sides = join_salted(met, tests.select("item", "words"), "item", "doc").join(regions.select("doc", "start", F.col("words").alias("text")), ["doc", "start"])

    def score(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        text, words = batch.column(3), batch.column(4)
        values = [c.values.to_numpy() for c in (text, words)]
        bounds = [c.offsets.to_numpy() for c in (text, words)]
        kept, scores, ends = [], [], []
        for i in range(batch.num_rows):
            passage, item = (v[o[i] : o[i + 1]] for v, o in zip(values, bounds, strict=True))
            if not may_leak(item, passage, threshold):
                continue
            best, end = align(item, passage)
            if best / (2 * len(item)) >= threshold:
                kept.append(i)
                scores.append(best / (2 * len(item)))
                ends.append(end + batch.column(1)[i].as_py())
        at = pa.array(kept, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(scores, pa.float64()), batch.column(1).take(at), pa.array(ends, pa.int64())], ["doc", "item", "score", "start", "end"])

    found = arrow_map(sides.select("doc", "start", "item", "text", "words"), score, "doc long, item long, score double, start long, end long")
    best = found.groupBy("doc", "item").agg(F.min(F.struct((-F.col("score")).alias("s"), "start", "end")).alias("b"))
    best = best.select("doc", "item", (-F.col("b.s")).alias("score"), "b.start", "b.end")
    if short.isEmpty():
        return best
    whole = _whole_texts(docs, doc_id, doc_text, n).join(short.select("item", "words"), "words").select("doc", "item", F.lit(1.0), F.lit(0).cast("long"), F.size("words").cast("long"))
    return best.union(whole.distinct())


def _whole_texts(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(doc, words) of documents of under n words."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = 0
        for w in words(pc.utf8_lower(batch.column(1)), PUNCTUATION):
            count = np.diff(w.first)
            few = np.flatnonzero((count > 0) & (count < n))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + few)), lists([w.hashes[w.first[i] : w.first[i + 1]] for i in few], pa.int64())], ["doc", "words"])
            at += len(count)

    ids = docs[id_col].cast("long")
    return arrow_map(docs.where(ids.isNotNull()).select(ids.alias("doc"), docs[text_col].alias("text")), run, "doc long, words array<long>")


def drop_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` less those that leak a test item; rows without an id stay."""
    gone = find_leaks(docs, items, doc_id=doc_id, **options).select(F.col("doc").alias(doc_id)).distinct()
    return docs.join(gone, doc_id, "left_anti").select(docs.columns)
