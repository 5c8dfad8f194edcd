import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from corpuslens.llm.packing import CAPACITY, Encoder, deal, differencing, pack, pack_block
from corpuslens.llm.queries import op7_packing, tokenizer_path

from ..conftest import TINY

ODD = ["", None, "Σίσυφος ΌΣ", "İstanbul ŉ ﬁ", "a\x85b c\x1cd", "<|endoftext|> x", "don't we'll 'em ''s", "x²½ 12 ª", "éÅ", "日本語 text", "word " * 9000]


def test_memo_equals_tokenizer():
    whole, encode = Tokenizer.from_file(tokenizer_path()), Encoder(tokenizer_path())
    texts = [t or "" for t in ODD]
    for text, got in zip(texts, encode(texts), strict=True):
        assert got.tolist() == whole.encode(text, add_special_tokens=False).ids, text[:30]


def test_differencing_is_near_equal():
    sizes = [8, 7, 6, 5, 4]
    parts = differencing(sizes, 2)
    assert sorted(i for p in parts for i in p) == [0, 1, 2, 3, 4]
    sums = sorted(sum(sizes[i] for i in p) for p in parts)
    assert sums == [14, 16]  # the method's classic example
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 513, 600).tolist()
    loads = [sum(sizes[i] for i in p) for p in deal(sizes)]
    assert max(loads) <= CAPACITY and len(loads) <= sum(sizes) // CAPACITY + 3


def test_window_count_rises():
    assert sorted(map(len, deal([5, 5, 5], 8))) == [1, 1, 1]


def test_block_tail_is_at_powers_of_two():
    windows = list(pack_block([(0, 0, 500), (1, 0, 300), (2, 0, 11)]))
    assert sorted(sum(p[2] for p in w) for w in windows) == [1, 2, 8, 32, 256, 512]


def check(rows, texts):
    whole = Tokenizer.from_file(tokenizer_path())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r[0]].append(r)
        by_seq[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys()
    for key, text in texts.items():
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(by_doc[key], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    waste = total = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= CAPACITY
        total += at
        waste += 0 if at & (at - 1) == 0 else CAPACITY - at
    return waste / total


def test_query_packs_every_id_once(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()}
    assert check(op7_packing(spark, TINY).collect(), docs) < 0.03


def test_edges(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    check(pack(docs, tokenizer_path()).collect(), dict(enumerate(ODD)))
    assert pack(docs.limit(0), tokenizer_path()).count() == 0
    twice = pack(docs.filter("doc_id = 6").union(docs.filter("doc_id = 6")), tokenizer_path(), with_ids=True).collect()
    assert sum(r.length for r in twice) == 2 * twice[0].doc_tokens and all(len(r.ids) == r.length for r in twice)


@pytest.mark.parametrize("k", [1, 3, 7])
def test_differencing_keeps_all(k):
    assert sorted(i for p in differencing([3] * 5, k) for i in p) == list(range(5))
