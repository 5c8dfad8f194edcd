"""Operator 7: sequence packing by Karmarkar-Karp multiway differencing.

Every text becomes token ids and one end id. Full windows are cut off as they are; what is left of each text is cut
into pieces of at most PIECE ids and gathered in blocks. In each block the pieces are dealt over k windows by the
largest differencing method: every piece starts as a partial partition with k loads, and the two partial partitions
whose loads differ most are merged with opposing order (largest load onto smallest) until one is left. k is the fewest
windows that could hold the block; while a load exceeds the capacity, k rises by one and the block is dealt anew.

A block is bounded (BLOCK windows), so memory is, and blocks follow the input's partitions: no shuffle, and a lost task
is recomputed alone. A window at a power of two needs no padding: the last, partial block of a partition is cut into
windows of such lengths where that is possible.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import arrow_stream
from .kernels import CHUNK, span_hashes

CAPACITY = 2048
END_ID = 1
PIECE = 512
BLOCK = 96
MEMO = 1_000_000


class Encoder:
    """Ids of the tokenizer in ``file``.

    The tokenizer splits a text into words and encodes each by itself, so words can be remembered: plain Latin texts
    are split and hashed with numpy, known words are looked up by their 64-bit hash, and only new ones are encoded. All
    other texts, and those with apostrophes or special tokens, go through the tokenizer whole. The memo holds at most
    MEMO words.
    """

    # The characters under U+0180 that the tokenizer's split takes for letters and for digits.
    _LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ňŊ-ž"
    _DIGITS = "0-9²³¹¼-¾"

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(file)
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.plain = re.compile("[\t-\r\x20-&(-\x7e¡-įı-ňŊ-ž–—‘-„†-•…€]*")
        # classes: 0 space, 1 letter, 2 digit, 3 other; of two-byte characters by both bytes
        kind = lambda c: 1 if re.match(f"[{self._LETTERS}]", c) else 2 if re.match(f"[{self._DIGITS}]", c) else 0 if c in "\t\n\x0b\f\r " else 3
        self.kind = np.array([kind(chr(i)) if i < 128 else 3 for i in range(256)], np.uint8)
        self.pairs = np.array([kind(chr(0x80 + i)) for i in range(0x180 - 0x80)], np.uint8)  # U+0080...
        self._forget()

    def _forget(self) -> None:
        self.known, self.at, self.size, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), [np.zeros(0, "<u4")]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without the end id."""
        out: list = [None] * len(texts)
        fast = []
        for i, text in enumerate(texts):
            if self.plain.fullmatch(text) and "<|" not in text:
                fast.append(i)
            else:
                out[i] = np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        at = 0
        while at < len(fast):
            to, size = at, 0
            while to < len(fast) and (to == at or size < CHUNK):
                size += len(texts[fast[to]])
                to += 1
            for i, ids in zip(fast[at:to], self._plain([texts[i].lower().encode() for i in fast[at:to]]), strict=True):
                out[i] = ids
            at = to
        return out

    def _plain(self, raws: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b"".join(raws), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in raws])))
        kind = self.kind[data]
        lead = np.flatnonzero((data >= 0xC2) & (data <= 0xC5))
        if len(lead):
            code = ((data[lead].astype(np.int64) & 0x1F) << 6 | (data[lead + 1] & 0x3F)) - 0x80
            kind[lead] = kind[lead + 1] = self.pairs[code]
        begins = np.ones(len(data), bool)
        begins[1:] = kind[1:] != kind[:-1]
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        begins |= (kind == 2) & ((data & 0xC0) != 0x80)
        edges = np.flatnonzero(begins)
        starts, ends = edges, np.append(edges[1:], len(data))
        solid = kind[starts] != 0
        starts, ends = starts[solid], ends[solid]
        hashes = span_hashes(data, starts, ends)
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > MEMO:
            self._forget()
        place = np.searchsorted(self.known, distinct)
        new = (self.known[np.minimum(place, len(self.known) - 1)] != distinct) if len(self.known) else np.ones(len(distinct), bool)
        if new.any():
            raw = data.tobytes()
            words = [raw[a:b] for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)]
            self._learn(distinct[new], place[new], words)
            place = np.searchsorted(self.known, distinct)
        if len(self.pool) > 1:
            self.pool = [np.concatenate(self.pool)]
        at, size = self.at[place][inverse], self.size[place][inverse]
        done = np.concatenate(([0], np.cumsum(size)))
        ids = self.pool[0][np.repeat(at - done[:-1], size) + np.arange(done[-1])]
        cuts = done[np.searchsorted(starts, offsets)]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _learn(self, hashes: np.ndarray, place: np.ndarray, words: list[bytes]) -> None:
        """Encodes new words many to a text; the last id of each is one that ends a word."""
        ids = np.array(self.whole.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words):
            each = [np.array(x.ids, "<u4") for x in self.whole.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
            ids, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
        held = sum(map(len, self.pool))
        starts = np.concatenate(([0], ends[:-1]))
        self.pool.append(ids)
        self.known = np.insert(self.known, place, hashes)
        self.at = np.insert(self.at, place, starts + held)
        self.size = np.insert(self.size, place, ends - starts)


_encoders: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    """The process's encoder, so that its memo serves all tasks of a worker."""
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """The k parts (lists of positions in ``sizes``) that the largest differencing method makes."""
    heap: list = []
    for i, size in enumerate(sizes):
        loads = np.zeros(k, np.int64)
        loads[-1] = size
        heap.append((-size, i, loads, [[]] * (k - 1) + [[i]]))
    if not heap:
        return [[] for _ in range(k)]
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heap[0]
        loads = a + b[::-1]  # opposing order: the largest load of one meets the smallest of the other
        order = np.argsort(loads, kind="stable")
        loads = loads[order]
        loads -= loads[0]
        parts = [in_a[j] + in_b[k - 1 - j] for j in order.tolist()]
        tick += 1
        heapq.heapreplace(heap, (-int(loads[-1]), tick, loads, parts))
    return heap[0][3]


def deal(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most ``capacity``: the fewest possible, one more whenever a load exceeds the capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = differencing(sizes, k)
        if all(sum(sizes[i] for i in p) <= capacity for p in parts):
            return [p for p in parts if p]
        k += 1


def pack_block(pieces: list[tuple[int, int, int]], capacity: int = CAPACITY) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of pieces (text, start, length). What is over whole windows' worth is cut off first into windows at
    powers of two, largest first; the rest is dealt by differencing."""
    total = sum(p[2] for p in pieces)
    over = total % capacity
    rest = list(pieces)
    tail: list[list[tuple[int, int, int]]] = []
    while over:
        size = 1 << (over.bit_length() - 1)
        over -= size
        window = []
        while size:
            text, start, length = rest.pop()
            if length > size:
                rest.append((text, start, length - size))
                text, start, length = text, start + length - size, size
            window.append((text, start, length))
            size -= length
        tail.append(window)
    if rest:
        for part in deal([p[2] for p in rest], capacity):
            yield [rest[i] for i in part]
    yield from tail


def pack(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids the ids themselves.

    A null or empty text is its end id alone. Repeated rows are packed as often as they occur. Texts of any length are
    cut into pieces; nothing is dropped. ``sequence_id`` is the partition's number and the window's number in it, so a
    recomputed task gives the same rows. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_file)
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        held: dict[int, np.ndarray] = {}  # what is left of the texts of the block, by number
        keys: dict[int, tuple] = {}
        pieces: list[tuple[int, int, int]] = []
        rows: list[list] = [[] for _ in range(8)]
        waiting = number = 0

        def put(window):
            nonlocal sequence
            offset = 0
            for text, start, length in window:
                key, base, total = keys[text]
                ids = held[text][start - base : start - base + length]
                for column, value in zip(rows, (key, start, length, zlib.crc32(ids), total, sequence, offset, ids if with_ids else None), strict=True):
                    column.append(value)
                offset += length
            sequence += 1

        def flush():
            nonlocal rows
            kinds = [id_type, *[pa.int64()] * 6]
            arrays = [pa.array(c, t) for c, t in zip(rows, kinds, strict=False)]
            if with_ids:
                arrays.append(pa.array(rows[7], pa.list_(pa.int32())))
            rows = [[] for _ in range(8)]
            return pa.RecordBatch.from_arrays(arrays, names)

        def close():
            nonlocal waiting
            for window in pack_block(pieces, capacity):
                put(window)
            pieces.clear()
            held.clear()
            keys.clear()
            waiting = 0

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids_of), 256):
                for key, ids in zip(ids_of[at : at + 256], encode([t or "" for t in texts[at : at + 256].to_pylist()]), strict=True):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    full = len(ids) // capacity * capacity
                    keys[number], held[number] = (key, 0, len(ids)), ids
                    for start in range(0, full, capacity):
                        put([(number, start, capacity)])
                    keys[number], held[number] = (key, full, len(ids)), ids[full:].copy()
                    pieces.extend((number, start, min(PIECE, len(ids) - start)) for start in range(full, len(ids), PIECE))
                    waiting += len(ids) - full
                    number += 1
                    if waiting >= BLOCK * capacity:
                        close()
            if len(rows[0]) >= 4096:
                yield flush()
        if pieces:
            close()
        if rows[0]:
            yield flush()

    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return arrow_stream(docs.select(docs[id_col], docs[text_col]), run, schema)
