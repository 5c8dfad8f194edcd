"""Operator 6: line dedup by a deletion-neighbourhood join.

Lines are compared as sequences of words (any case of A-Z). Equal lines are one class with its earliest occurrence (by
document id, then line). Classes of NEAR_WORDS or more words are also compared within one word edit - a word put in,
left out or changed:

1. A line within one edit of another shares its first or its last half with it. Lines of which no half occurs in
   another line have no partner and leave the join.
2. The others emit all variants within the bound as hashed keys: the line itself, and each line that is left when one
   word is deleted, once with and once without the word's position. Equal keys join: with position for a changed
   word, a deletion variant with a whole line for a word put in or left out. Each key only needs its earliest line, so
   keys are aggregated before they are joined and no key's lines are paired with each other.
3. The edit distance of every joined pair is verified on the words. A line goes if an earlier line is within the bound.

With ``words_per_edit`` long lines may differ by more: by one edit for each so many words of the longer one. All variants
within such a bound would be too many, so those that are emitted leave but a run of words:

4. Two such lines share a run of some words (``shared_run``), so they share an anchor: the least hash of the runs of
   ANCHOR_WORDS words in a window, whatever stands around it. Anchors of one line only leave; the others are joined.
5. An edit changes at most two words of a line's bag, so the XOR of two odd sketches of the bags (parity bitmaps) has at
   most two bits for each edit; pairs with more bits leave before their words are read.
6. Each line is verified against the earliest line of each of its anchors. What has no partner yet is compared with all
   earlier lines with one of its anchors at a place and a length that the bound allows: by keys of anchor, length and
   place, so that a passage that many unlike lines hold doesn't make pairs of all of them. The closest by sketch is
   verified first, all others only for lines that are left then.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bitmap, free_names, in_bitmap, join_keyed, join_salted, stage
from .kernels import Spans, Words, chunks, mix, run_hashes, words_of

NEAR_WORDS = 6
#: Words of an anchor; the shortest run that two lines must share.
ANCHOR_WORDS, RUN = 6, 13
#: Bits of a line's odd sketch, and by how much lengths of one class differ at most.
BITS, CLASS = 512, 1.12
#: An anchor that more lines hold is joined by length and place too.
OFTEN = 128
_LONGS = [f"s{i}" for i in range(BITS // 64)]
_SALT = np.uint64(0x51ED270B9F1A3C25)


def _line_words(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, Words]]:
    """Of each chunk: row of the batch and number in its text for every line, and the lines' words."""
    for rows, raw, offsets in chunks(column):
        breaks = np.flatnonzero(raw == 10) + 1
        starts = np.sort(np.concatenate((offsets[:-1], breaks)), kind="stable")
        # an empty text shares its offset with the next one, so texts are counted apart from places
        text = np.sort(np.concatenate((np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks - 1, "right") - 1)), kind="stable")
        number = np.arange(len(text)) - np.searchsorted(text, text)
        yield text + rows.start, number, words_of(rows, raw, np.append(starts, len(raw)))


def _hashed(w: Words, s: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each line and its count of words. The second has its own word hashes."""
    a, b = w.first[:-1], w.first[1:]
    return s.of(a, b), Spans(mix(w.hashes ^ _SALT)).of(a, b), b - a


def _place_hash(ids: np.ndarray, number: np.ndarray) -> np.ndarray:
    return mix(mix(ids.view(np.uint64)) + number.astype(np.uint64))


def _runs(hashes: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A list column of consecutive runs of hashes."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(hashes.view(np.int64)))


def _rows_in(bits: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows whose first column, an id, is in the bitmap: other documents' words need not be read."""
    return batch.filter(pa.array(in_bitmap(bits, batch.column(0).to_numpy())))


def occurrences(docs: DataFrame, id_col: str, text_col: str, near_words: int = NEAR_WORDS) -> DataFrame:
    """(id, line, p, h1, h2, size, b0..b3): every line with words; p: a hash of its place, b: of its halves, null for short lines and where two are one."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key = batch.column(0).to_numpy()
        for text, number, w in _line_words(batch.column(1)):
            s = Spans(w.hashes)
            h1, h2, size = _hashed(w, s)
            a, b = w.first[:-1], w.first[1:]
            halves = []
            for length in (size // 2, (size + 1) // 2):
                halves += [mix(s.of(a, np.minimum(a + length, b)) + np.uint64(1)), mix(s.of(np.maximum(b - length, a), b) + np.uint64(2))]
            there, short = size > 0, size < near_words
            once = short | (size % 2 == 0)  # of an even line both lengths are one
            at = pa.array(text[there])
            arrays = [batch.column(0).take(at), pa.array(number[there].astype(np.int32)), *(pa.array(h[there].view(np.int64)) for h in (_place_hash(key[text], number), h1, h2)), pa.array(size[there].astype(np.int32))]
            arrays += [pa.array(h[there].view(np.int64), mask=no[there]) for h, no in zip(halves, (short, short, once, once), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "line", "p", "h1", "h2", "size", "b0", "b1", "b2", "b3"])

    ids = docs[id_col].cast("long")
    return arrow_map(docs.where(ids.isNotNull()).select(ids.alias("id"), docs[text_col].alias("text")), run, "id long, line int, p long, h1 long, h2 long, size int, b0 long, b1 long, b2 long, b3 long")


def _neighbourhoods(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, near_words: int) -> DataFrame:
    """(id, line, h1, h2, words, start, variants) of the lines of ``wanted`` (id, p, heads, tails) and a few others; of equal lines in a chunk the earliest.

    heads and tails say which half of the line occurs in another line; the words of the other half are left out one by one, from word ``start`` on.
    """
    bits = docs.sparkSession.sparkContext.broadcast((bitmap(wanted, "id"), bitmap(wanted.where("heads"), "p"), bitmap(wanted.where("tails"), "p")))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        batch = _rows_in(bits.value[0], batch)
        key = batch.column(0).to_numpy()
        for text, number, w in _line_words(batch.column(1)):
            s = Spans(w.hashes)
            h1, h2, size = _hashed(w, s)
            p = _place_hash(key[text], number)
            head, tail = in_bitmap(bits.value[1], p), in_bitmap(bits.value[2], p)
            pick = np.flatnonzero((size >= near_words) & (head | tail))
            pick = pick[np.lexsort((number[pick], key[text[pick]], h1[pick]))]
            pick = pick[np.append(True, h1[pick][1:] != h1[pick][:-1])] if len(pick) else pick
            a, b = w.first[:-1][pick], w.first[1:][pick]
            n = b - a
            start, stop = np.where(tail[pick], 0, n // 2), np.where(head[pick], n, n - n // 2)
            count = stop - start
            gone = s.without(np.repeat(a, count), np.repeat(b, count), _ragged(a + start, count))
            arrays = [pa.array(key[text[pick]]), pa.array(number[pick].astype(np.int32)), *(pa.array(h[pick].view(np.int64)) for h in (h1, h2))]
            arrays += [_runs(w.hashes[_ragged(a, n)], n), pa.array(start.astype(np.int32)), _runs(gone, count)]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "line", "h1", "h2", "words", "start", "variants"])

    ids = docs[id_col].cast("long")
    return arrow_map(docs.where(ids.isNotNull()).select(ids.alias("id"), docs[text_col].alias("text")), run, "id long, line int, h1 long, h2 long, words array<long>, start int, variants array<long>")


def within_one(x: list[int], y: list[int]) -> bool:
    """Word edit distance of at most 1."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    i = 0
    while i < len(x) and x[i] == y[i]:
        i += 1
    return x[i:] == y[i + 1 :] or len(x) == len(y) and x[i + 1 :] == y[i + 1 :]


def within(x: list[int], y: list[int], bound: int) -> int | None:
    """Word edit distance if it is at most ``bound``, by the furthest places that each number of edits reaches."""
    n, m = len(x), len(y)
    if abs(n - m) > bound:
        return None
    far: dict[int, int] = {}  # by diagonal (place in y less place in x): furthest place in x
    for edits in range(bound + 1):
        now = {}
        for d in range(-edits, edits + 1):
            i = max(far.get(d, -2) + 1, far.get(d + 1, -2) + 1, far.get(d - 1, -2)) if edits else 0
            i = min(i, n, m - d)
            if i < 0 or i + d < 0:
                continue
            while i < n and i + d < m and x[i] == y[i + d]:
                i += 1
            if i == n and i + d == m:
                return edits
            now[d] = i
        far = now
    return None


def shared_run(words: int, words_per_edit: int) -> int:
    """How long a run of words a line of so many words shares at least with any line within the bound, where that is two edits or more."""
    longest = max(words, 2 * words_per_edit)
    runs = (-(-(n - n // words_per_edit) // (n // words_per_edit + 1)) for n in range(longest, max(longest, words * words_per_edit // (words_per_edit - 1) + 1) + 1))
    return min(runs)


def _windows(words_per_edit: int) -> np.ndarray:
    """By number of words: the window of a line's anchors. What a wider window picks in a shared run, a narrower one picks too, so lines of other lengths agree."""
    known = np.array([shared_run(max(n, 1), words_per_edit) for n in range(100 * words_per_edit)])
    # runs of longer lines are no shorter than the last whole round's
    known[-1] = known[-words_per_edit * 4 :].min()
    return known - ANCHOR_WORDS + 1


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of consecutive runs: counts[i] from starts[i] on."""
    return np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())


def _sliding(x: np.ndarray, size: int, best: np.ufunc) -> np.ndarray:
    """``best`` (minimum or maximum) of each ``size`` consecutive values, by doubling."""
    out, have = x, 1
    while have < size:
        step = min(have, size - have)
        out = best(out[:-step], out[step:])
        have += step
    return out


def _anchors(w: Words, lines: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, anchor, lo, hi): the distinct anchors of ``lines``, in order, with their first and last places in the line."""
    g, count = run_hashes(w.hashes, ANCHOR_WORDS), np.diff(w.first)
    width = windows[np.minimum(count[lines], len(windows) - 1)]
    picked = []
    for size in np.unique(width):
        some = lines[width == size]
        n = count[some] - ANCHOR_WORDS + 1  # grams of a line
        at = _ragged(w.first[some], n)
        own = g[at]
        least = _sliding(own, size, np.minimum)
        end = np.cumsum(n)
        # windows that reach into the next line pick nothing
        for k in range(1, size):
            over = end[:-1] - k
            least[over[over < len(least)]] = 0
        # a gram is an anchor if it is the least of a window: the largest of all windows over it is the gram itself
        wide = np.zeros(len(own) + size - 1, np.uint64)
        wide[size - 1 : size - 1 + len(least)] = least
        picked.append(at[_sliding(wide, size, np.maximum) == own])
    at = np.sort(np.concatenate(picked)) if picked else np.zeros(0, np.int64)
    line, anchor = np.searchsorted(w.first, at, "right") - 1, g[at]
    order = np.lexsort((anchor, line))  # stable: places stay in order
    at, line, anchor = at[order], line[order], anchor[order]
    begin = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (anchor[1:] != anchor[:-1]))) if len(at) else at
    place = at - w.first[line]
    return line[begin], anchor[begin], place[begin], place[np.append(begin[1:], len(at)) - 1] if len(at) else place


def _anchor_rows(docs: DataFrame, id_col: str, text_col: str, least: int, windows: np.ndarray, firsts: DataFrame) -> DataFrame:
    """(anchor): the distinct anchors of each line of ``least`` or more words, of equal lines only the earliest and a few others."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(firsts, "p"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key = batch.column(0).to_numpy()
        for text, number, w in _line_words(batch.column(1)):
            p = _place_hash(key[text], number)
            _, anchor, _, _ = _anchors(w, np.flatnonzero((np.diff(w.first) >= least) & in_bitmap(bits.value, p)), windows)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64))], ["anchor"])

    ids = docs[id_col].cast("long")
    return arrow_map(docs.where(ids.isNotNull()).select(ids.alias("id"), docs[text_col].alias("text")), run, "anchor long")


def _sketches(w: Words, lines: np.ndarray) -> np.ndarray:
    """(lines, BITS // 64): for each bit whether an odd number of the line's words falls on it. A word's second occurrence is another word than its first."""
    out = np.zeros((len(lines), BITS // 64), np.int64)
    low = np.uint64((1 << 54) - 1)
    for at in range(0, len(lines), 1024):
        some = lines[at : at + 1024]
        a, n = w.first[some], w.first[some + 1] - w.first[some]
        own = np.sort((np.repeat(np.arange(len(some), dtype=np.uint64), n) << np.uint64(54)) | (w.hashes[_ragged(a, n)] >> np.uint64(10)))
        here = np.arange(len(own))
        again = here - np.maximum.accumulate(np.where(np.append(True, own[1:] != own[:-1])[: len(own)], here, 0)) if len(own) else here
        bit = mix((own & low) + again.astype(np.uint64) * _SALT).astype(np.int64) & (BITS - 1)
        odd = np.bincount((own >> np.uint64(54)).astype(np.int64) * BITS + bit, minlength=len(some) * BITS).astype(np.uint8) & 1
        out[at : at + 1024] = np.packbits(odd.reshape(len(some), BITS), axis=1).view(np.int64)
    return out


def _anchored(docs: DataFrame, id_col: str, text_col: str, least: int, windows: np.ndarray, firsts: DataFrame, shared: DataFrame) -> DataFrame:
    """(id, line, p, size, anchors, lo, hi, s0...) of the earliest lines of ``least`` or more words that hold one of ``shared`` (and a few others)."""
    bits = docs.sparkSession.sparkContext.broadcast((bitmap(firsts, "p"), bitmap(shared, "anchor")))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key = batch.column(0).to_numpy()
        for text, number, w in _line_words(batch.column(1)):
            p = _place_hash(key[text], number)
            line, anchor, lo, hi = _anchors(w, np.flatnonzero((np.diff(w.first) >= least) & in_bitmap(bits.value[0], p)), windows)
            hit = in_bitmap(bits.value[1], anchor)
            line, anchor, lo, hi = line[hit], anchor[hit], lo[hit], hi[hit]
            pick, begin = np.unique(line, return_index=True)
            sketch, bounds = _sketches(w, pick), pa.array(np.append(begin, len(line)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(text[pick])),
                    pa.array(number[pick].astype(np.int32)),
                    pa.array(p[pick].view(np.int64)),
                    pa.array((w.first[pick + 1] - w.first[pick]).astype(np.int32)),
                    pa.ListArray.from_arrays(bounds, pa.array(anchor.view(np.int64))),
                    *(pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (lo, hi)),
                    *(pa.array(np.ascontiguousarray(c)) for c in sketch.T),
                ],
                ["id", "line", "p", "size", "anchors", "lo", "hi", *_LONGS],
            )

    ids = docs[id_col].cast("long")
    longs = ", ".join(f"{x} long" for x in _LONGS)
    return arrow_map(docs.where(ids.isNotNull()).select(ids.alias("id"), docs[text_col].alias("text")), run, f"id long, line int, p long, size int, anchors array<long>, lo array<int>, hi array<int>, {longs}")


def _words_at(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(id, line, words) of the lines of ``wanted`` (id, p) and a few others. Only documents that hold one are split into words."""
    bits = docs.sparkSession.sparkContext.broadcast((bitmap(wanted, "id"), bitmap(wanted, "p")))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        batch = _rows_in(bits.value[0], batch)
        key = batch.column(0).to_numpy()
        for text, number, w in _line_words(batch.column(1)):
            pick = np.flatnonzero(in_bitmap(bits.value[1], _place_hash(key[text], number)))
            n = w.first[pick + 1] - w.first[pick]
            words = _runs(w.hashes[_ragged(w.first[pick], n)], n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text[pick])), pa.array(number[pick].astype(np.int32)), words], ["id", "line", "words"])

    ids = docs[id_col].cast("long")
    return arrow_map(docs.where(ids.isNotNull()).select(ids.alias("id"), docs[text_col].alias("text")), run, "id long, line int, words array<long>")


def _class_of(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / np.log(CLASS)).cast("int")


def _cell_width(kind: Column, words_per_edit: int) -> Column:
    """Twice the largest shift between a line of this class of lengths and any line within the bound."""
    longest = F.pow(F.lit(CLASS), kind + 1) * (words_per_edit / (words_per_edit - 1))
    return 2 * (F.floor(longest / words_per_edit).cast("int") + 1)


def _compared(near: DataFrame, words_per_edit: int) -> tuple[DataFrame, DataFrame, Column, Column]:
    """Lines, the same as o_ lines, whether a line and an o_ line may be within the bound, and the odd bits of their sketches.

    With s changed and i other edits their bags differ by at most 2 * s + i words and their lengths by at most i.
    """
    thin = near.select("at", "p", "size", *_LONGS)
    other = thin.select(*[F.col(c).alias("o_" + c) for c in thin.columns])
    apart, z = F.abs(F.col("size") - F.col("o_size")), sum((F.bit_count(F.col(s).bitwiseXOR(F.col("o_" + s))) for s in _LONGS), F.lit(0))
    bound = _bound(words_per_edit)
    return thin, other, (apart <= bound) & (z + apart <= 2 * bound), z


def _bound(words_per_edit: int) -> Column:
    return F.floor(F.greatest("size", "o_size") / words_per_edit).cast("int")


def _held(near: DataFrame) -> DataFrame:
    """(at, size, anchor, lo, hi): each anchor of each line."""
    rows = near.select("at", "size", F.explode(F.arrays_zip("anchors", "lo", "hi")).alias("a"))
    return rows.select("at", "size", F.col("a.anchors").alias("anchor"), "a.lo", "a.hi")


def _meetings(near: DataFrame, light: DataFrame, words_per_edit: int) -> DataFrame:
    """Pairs of a line of ``light`` (rows of ``_held``, first and often) and an earlier line of ``near`` that may be within the bound.

    They meet at each anchor that both hold and whose first line is neither of them: pairs with first lines have been
    compared. Where an anchor is held often, class of length and cell of place are keys too.
    """
    thin, other, alike, _ = _compared(near, words_per_edit)
    width = _cell_width(F.col("kind"), words_per_edit)
    shift = F.floor(F.col("size") / (words_per_edit - 1)).cast("int")
    if_often = lambda value: F.when(F.col("often"), value).otherwise(F.array(F.lit(0)))
    cells = lambda low, high: F.explode(if_often(F.sequence(F.floor(low / width).cast("int"), F.floor(high / width).cast("int"))))

    base = _held(near).join(light.select("anchor", "first", "often").distinct(), "anchor").where("at <> first")
    base = base.withColumn("kind", F.when(F.col("often"), _class_of(F.col("size"))).otherwise(0)).withColumn("cell", cells(F.col("lo"), F.col("hi")))
    base = base.select("at", "anchor", "kind", "cell", F.col("lo").alias("o_lo"), F.col("hi").alias("o_hi")).join(other, F.col("at") == F.col("o_at")).drop("at")
    light = light.join(thin.drop("size"), "at").withColumn("kind", F.explode(if_often(F.sequence(_class_of(F.col("size") - shift), _class_of(F.col("size") + shift)))))
    light = light.withColumn("cell", cells(F.col("lo") - width / 2, F.col("hi") + width / 2))
    bound = _bound(words_per_edit)
    fits = (F.col("lo") - F.col("o_hi") <= bound) & (F.col("o_lo") - F.col("hi") <= bound)
    return light.join(base, ["anchor", "kind", "cell"]).where((F.col("o_at") < F.col("at")) & fits & alike)


def _far(docs: DataFrame, id_col: str, text_col: str, classes: DataFrame, settled: DataFrame, place: Callable[[Column, Column], Column], id_of: Callable[[str], Column], words_per_edit: int) -> DataFrame:
    """(at, keep, distance): lines with an earlier line within one edit for each ``words_per_edit`` words, two at least, less those of ``settled`` (at)."""
    spark = docs.sparkSession
    if 2 * words_per_edit < 3 * RUN:
        raise ValueError(f"words_per_edit under {-(-3 * RUN // 2)}: near lines need not share a run of {RUN} words")
    least = 2 * words_per_edit - 2  # of the shorter line, where the longer one has two edits
    windows = _windows(words_per_edit)
    wanted = stage(spark, classes.where(F.col("size") >= least).select(F.col("rep").alias("at"), "p"), "long-lines", narrow=True)
    shared = _anchor_rows(docs, id_col, text_col, least, windows, wanted).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    shared = stage(spark, shared, "anchors", narrow=True)
    drawn = stage(spark, _anchored(docs, id_col, text_col, least, windows, wanted, shared).withColumn("at", place(F.col("id"), F.col("line"))).drop("id", "line"), "anchored")
    near = drawn.join(wanted, "at", "left_semi").dropDuplicates(["at"]).join(settled.withColumn("done", F.lit(True)), "at", "left")
    near = stage(spark, near.withColumn("done", F.coalesce("done", F.lit(False))), "near-lines")
    thin, other, alike, z = _compared(near, words_per_edit)
    kind = near.schema["at"].dataType.simpleString()

    def words_for(pairs: DataFrame, label: str) -> DataFrame:
        ends = pairs.select(id_of("at").alias("id"), "p").union(pairs.select(id_of("keep"), "o_p"))
        found = _words_at(docs, id_col, text_col, ends).withColumn("at", place(F.col("id"), F.col("line")))
        return stage(spark, found.select("at", F.col("words").alias("x")), label)

    def verified(pairs: DataFrame, words: DataFrame, label: str) -> DataFrame:
        seen = join_salted(pairs.select("at", "keep"), words.withColumnsRenamed({"at": "keep", "x": "y"}), "keep", "at").join(words, "at").select("at", "keep", "x", "y")

        def verify(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            edits = [within(x, y, max(len(x), len(y)) // words_per_edit) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(edits, pa.int32())], ["at", "keep", "distance"])
            yield out.filter(out.column(2).is_valid())

        found = arrow_map(seen, verify, f"at {kind}, keep {kind}, distance int")
        return stage(spark, found.groupBy("at").agg(F.min(F.struct("keep", "distance")).alias("b")).select("at", "b.keep", "b.distance"), label, narrow=True)

    firsts = near.select("at", F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.min("at").alias("keep"), F.max("at").alias("last"), F.count("*").alias("n")).where("keep <> last")
    firsts = stage(spark, firsts.select("anchor", "keep", "n"), "first-anchors", narrow=True)
    open_ = near.where(~F.col("done"))
    led = join_keyed(open_.select("at", F.explode("anchors").alias("anchor")), firsts, ["anchor"], "n")
    led = stage(spark, led.where("keep < at").select("at", "keep").distinct(), "led", narrow=True)
    led = join_salted(led, other.withColumnRenamed("o_at", "keep"), "keep", "at").join(thin, "at").where(alike).select("at", "keep", "p", "o_p")
    led = stage(spark, led, "led-alike", narrow=True)
    first = verified(led, words_for(led, "led-words"), "far-first")

    rest = stage(spark, open_.select("at").join(first.select("at"), "at", "left_anti"), "open", narrow=True)
    # whom an anchor's first line leads, that has been compared with it
    more = firsts.where("n > 2").select("anchor", F.col("keep").alias("first"), (F.col("n") > OFTEN).alias("often"))
    light = stage(spark, _held(near).join(rest, "at", "left_semi").join(more, "anchor").where("first < at"), "open-anchors", narrow=True)
    met = _meetings(near, light, words_per_edit)
    met = met.select("at", F.col("o_at").alias("keep"), "p", "o_p", z.alias("z")).distinct().join(led.select("at", "keep"), ["at", "keep"], "left_anti")
    met = stage(spark, met, "met", narrow=True)
    words = words_for(met, "met-words")
    closest = stage(spark, met.groupBy("at").agg(F.min(F.struct("z", "keep")).alias("b")).select("at", "b.keep"), "closest", narrow=True)
    second = verified(closest, words, "far-second")
    others = met.select("at", "keep").join(second.select("at"), "at", "left_anti").join(closest, ["at", "keep"], "left_anti")
    third = verified(stage(spark, others, "others", narrow=True), words, "far-third")
    return first.union(second).union(third)


def _places(lines: DataFrame) -> tuple[Callable[[Column, Column], Column], Callable[[str], Column], Callable[[str], Column]]:
    """How a line's place (document, line) is one value in its order, and how to read it.

    A whole number where all ids and line numbers fit it, which aggregates without sorting; else a struct.
    """
    low, high, last = lines.agg(F.min("id"), F.max("id"), F.max("line")).first()
    if low is None or low >= 0 and high < 1 << 42 and last < 1 << 21:
        return (
            lambda i, n: F.shiftleft(i, 21).bitwiseOR(n.cast("long")),
            lambda c: F.shiftright(F.col(c), 21),
            lambda c: F.col(c).bitwiseAND((1 << 21) - 1).cast("int"),
        )
    return (lambda i, n: F.struct(i.alias("id"), n.alias("line")), lambda c: F.col(c)["id"], lambda c: F.col(c)["line"])


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_edit: int | None = None, near_words: int = NEAR_WORDS) -> DataFrame:
    """(id, line, keep_id, keep_line, distance): each line that goes, and the earliest line that it repeats.

    distance is 0 for an equal line and 1 for one within a word edit, which is looked for from ``near_words`` words on. With ``words_per_edit`` also lines of 2 * words_per_edit
    or more words go, with their number of edits; the line named is an earlier one within the bound, not always the earliest. Lines are numbered from 0 at each U+000A; lines
    without words and rows without an id are never duplicates; null and empty texts have none. Rows with one id are one
    document: their equal lines of one number are one line. An empty table gives no rows.
    """
    spark = docs.sparkSession
    lines = stage(spark, occurrences(docs, id_col, text_col, near_words), "lines")
    place, id_of, line_of = _places(lines)
    at = place(F.col("id"), F.col("line"))
    classes = lines.groupBy("h1", "h2").agg(F.min(at).alias("rep"), F.max(at).alias("last"), F.min_by("p", at).alias("p"), *[F.max(c).alias(c) for c in ("size", "b0", "b1", "b2", "b3")])
    classes = stage(spark, classes, "line-classes")
    again = classes.where("rep <> last").select("h1", "h2", "rep")
    exact = lines.select("h1", "h2", at.alias("at")).join(again, ["h1", "h2"]).where("at <> rep")
    exact = exact.select(id_of("at").alias("id"), line_of("at").alias("line"), id_of("rep").alias("keep_id"), line_of("rep").alias("keep_line"), F.lit(0).alias("distance"))

    halves = classes.where(F.col("size") >= near_words).select("h1", F.posexplode(F.array("b0", "b1", "b2", "b3")).alias("side", "half")).where("half is not null")
    # a class has each of its halves once
    met = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    partners = halves.join(met, "half").groupBy("h1").agg(*[F.max(F.col("side") % 2 == k).alias(side) for k, side in enumerate(("heads", "tails"))])
    partners = stage(spark, partners, "line-candidates", narrow=True)
    wanted = stage(spark, classes.join(partners, "h1").select("h1", "h2", "rep", "p", id_of("rep").alias("id"), "heads", "tails"), "wanted-lines", narrow=True)
    drawn = _neighbourhoods(docs, id_col, text_col, wanted, near_words).withColumn("at", at)
    near = stage(spark, drawn.join(wanted, (drawn.h1 == wanted.h1) & (drawn.h2 == wanted.h2) & (drawn["at"] == wanted.rep)).select("at", drawn.h1, "words", "start", "variants"), "neighbourhoods")

    changed = near.select("at", "start", F.posexplode("variants").alias("p", "v")).select("at", F.xxhash64("v", F.col("start") + F.col("p")).alias("key"))
    first = changed.groupBy("key").agg(F.min("at").alias("keep"), F.max("at").alias("last")).where("keep <> last").select("key", "keep")
    swaps = changed.join(first, "key").where("at <> keep").select("at", "keep")
    shorter = near.select("at", F.explode(F.array_distinct("variants")).alias("key"))
    whole = near.select(F.col("h1").alias("key"), F.col("at").alias("whole"))
    cut = stage(spark, shorter.join(whole, "key").select("at", "whole"), "cut-lines", narrow=True)
    # the whole line repeats the earliest that holds it and a word more; each longer line repeats the whole line
    least = cut.groupBy("whole").agg(F.min("at").alias("keep")).select(F.col("whole").alias("at"), "keep")
    pairs = swaps.union(least.where("keep < at")).union(cut.where("whole < at").select("at", F.col("whole").alias("keep"))).distinct()
    seen = pairs.join(near.select("at", F.col("words").alias("x")), "at").join(near.select(F.col("at").alias("keep"), F.col("words").alias("y")), "keep")

    def verify(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ok = [within_one(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:4]], ["id", "line", "keep_id", "keep_line"])

    flat = seen.select(id_of("at").alias("id"), line_of("at").alias("line"), id_of("keep").alias("keep_id"), line_of("keep").alias("keep_line"), "x", "y")
    verified = arrow_map(flat, verify, "id long, line int, keep_id long, keep_line int").withColumn("keep", place(F.col("keep_id"), F.col("keep_line")))
    edited = verified.groupBy("id", "line").agg(F.min("keep").alias("keep")).select("id", "line", id_of("keep").alias("keep_id"), line_of("keep").alias("keep_line"), F.lit(1).alias("distance"))
    if words_per_edit is None:
        return exact.union(edited)
    edited = stage(spark, edited, "edited", narrow=True)
    far = _far(docs, id_col, text_col, classes, edited.select(at.alias("at")), place, id_of, words_per_edit)
    return exact.union(edited).union(far.select(id_of("at").alias("id"), line_of("at").alias("line"), id_of("keep").alias("keep_id"), line_of("keep").alias("keep_line"), "distance"))


def drop_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars", **options) -> DataFrame:
    """``docs`` without the lines of ``duplicate_lines``, which takes the other options; a document goes when all its lines with words go.

    ``count_col``, where given and present, becomes the new text's length in characters. Documents that lose no line are
    returned as they are, null and empty texts included. Columns may have any names.
    """
    gone, gone_id = free_names(docs, count=2)
    cuts = duplicate_lines(docs, id_col, text_col, **options).groupBy("id").agg(F.collect_set("line").alias(gone)).withColumnRenamed("id", gone_id)
    joined = docs.join(cuts, docs[id_col].cast("long") == F.col(gone_id), "left").drop(gone_id)
    at = joined.columns.index(text_col)

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, cuts = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
        for i, lines in enumerate(cuts):
            if lines:
                out = set(lines)
                rest = [x for k, x in enumerate(texts[i].split("\n")) if k not in out]
                texts[i] = "\n".join(rest) if any(x.strip(" \t\r\x0b\x0c") for x in rest) else None
        stays = pa.array([t is not None or not c for t, c in zip(texts, cuts, strict=True)], pa.bool_())
        columns = list(batch.columns[:-1])
        columns[at] = pa.array(texts, columns[at].type)
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1]).filter(stays)

    out = arrow_map(joined, cut, joined.drop(gone).schema)
    if count_col in docs.columns:
        changed = F.when(F.col(text_col).isNull(), F.col(count_col)).otherwise(F.char_length(text_col))
        out = out.withColumn(count_col, changed.cast(docs.schema[count_col].dataType))
    return out
