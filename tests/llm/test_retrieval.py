"""Retrieval packing against the tokenizer itself, plain BM25 and the laws of a packing."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tenura.llm import retrieval as R
from tenura.llm.wordtable import WordTable

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(public_tokenizers.path(R.TOKENIZER))


def ids_of(plain, text):
    return plain.encode(text or "", add_special_tokens=False).ids + [R.END_ID]


def test_ids_are_the_tokenizers(plain):
    own = R.ByteCoder(public_tokenizers.path(R.TOKENIZER), public_tokenizers.path(R.RANKS))
    rng = random.Random(2)
    parts = ["a", "b", " ", " ", "\n", "  ", ".", ",", "é", "日", "1", "'s", "<|endoftext|>", "\t", " ", " ", "\r", "\x1c", "\x85", "word", "Hello", "w" * 50]
    for _ in range(1000):
        texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(8)]
        for text, ids in zip(texts, list(own.texts(texts))):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_table_that_is_too_small_still_answers():
    """Places are taken over and the ids start anew all the time."""
    def encode(words):
        return np.array([b for w in words for b in w], np.uint16), np.array([len(w) for w in words])

    rng = random.Random(4)
    table = WordTable(encode, np.uint16, slots=8, room=60)
    for _ in range(200):
        words = [bytes(rng.choices(b"abc", k=rng.choice([1, 2, 3, 40]))) for _ in range(rng.randint(1, 12))]
        ends = np.cumsum([len(w) for w in words])
        ids, n = table.find(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
        assert bytes(ids.astype(np.uint8)) == b"".join(words) and n.tolist() == [len(w) for w in words]


def test_scores_are_bm25():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 40, rng.integers(1, 60)).astype(np.uint16) for _ in range(30)]
    seen = np.zeros(R.VOCABULARY)
    for d in docs:
        seen[np.unique(d)] += 1
    idf, mean = R.inverse_frequencies(seen, len(docs)), sum(map(len, docs)) / len(docs)
    query = R.query_terms(docs[0], idf)
    counts = Counter(docs[0].tolist())
    weight = {t: math.log(1 + (30 - seen[t] + 0.5) / (seen[t] + 0.5)) for t in range(40)}
    assert query.tolist() == sorted(counts, key=lambda t: (-weight[t] * counts[t] / (counts[t] + R.K1), t))[: R.QUERY_TERMS]
    got = R.Shard(docs, idf, mean).scores(query)
    for doc, score in zip(docs, got):
        tf = Counter(doc.tolist())
        want = sum(weight[t] * tf[t] * (R.K1 + 1) / (tf[t] + R.K1 * (1 - R.B + R.B * len(doc) / mean)) for t in query.tolist())
        assert math.isclose(score, want, rel_tol=1e-9, abs_tol=1e-12)


def plain_order(docs, idf, mean, capacity):
    """The order in which documents enter windows, and each one's score, by plain loops over one shard."""
    index = R.Shard(docs, idf, mean)
    unused, order, fill, seed = list(range(len(docs))), [], 0, None
    scores = None
    while unused:
        if seed is None:
            best, score = unused[0], None
        else:
            if scores is None:
                scores = index.scores(R.query_terms(docs[seed], idf))
            score = max(scores[i] for i in unused)
            best = next(i for i in unused if scores[i] == score) if score > 0 else unused[0]
            score = score if score > 0 else None
        unused.remove(best)
        order.append((best, score))
        size = len(docs[best]) + 1
        if fill + size >= capacity or seed is None:
            if fill + size >= capacity:
                scores = None
                seed = best if (fill + size) % capacity else None
            else:
                seed = best
        fill = (fill + size) % capacity
    return order


def test_neighbours_enter_in_the_order_of_their_scores():
    rng = np.random.default_rng(7)
    docs = [rng.integers(0, 300, rng.integers(0, 90)).astype(np.uint16) for _ in range(120)]
    seen = np.zeros(R.VOCABULARY)
    for d in docs:
        seen[np.unique(d)] += 1
    idf, mean = R.inverse_frequencies(seen, len(docs)), sum(map(len, docs)) / len(docs)
    packer = R.Packer(64, 0)
    packer.fill(list(enumerate(docs)), idf, mean)
    packer.finish()
    first = {}
    for key, start, *_, score in packer.rows:
        first.setdefault(key, score)
    want = plain_order(docs, idf, mean, 64)
    # The last window is laid out anew in powers of two, in the same order.
    assert list(first.items()) == want


def checked(rows, texts, plain, capacity=R.CAPACITY):
    """The laws: each id in one piece, sequences without gaps, padding only in sequences that are no power of two."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    want = defaultdict(list)
    for key, text in texts:
        want[key].append(ids_of(plain, text))
    assert set(by_doc) == set(want)
    for key, docs in want.items():
        pieces = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[key])
        assert sum(length for _, length, *_ in pieces) == sum(map(len, docs))
        if len(docs) == 1:
            at = 0
            for start, length, crc, tokens in pieces:
                assert start == at and length > 0 and tokens == len(docs[0])
                assert crc == zlib.crc32(np.array(docs[0][start : start + length], "<u4").tobytes())
                at += length
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_table(spark, folder, plain):
    texts = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    rows = R.query(spark, folder).collect()
    assert checked(rows, texts, plain) == 0
    assert np.mean([r.bm25 is not None for r in rows if r.start == 0]) > 0.5


def test_nulls_empty_long_repeated_and_clashing(spark, plain):
    texts = [(1, None), (2, ""), (None, "alone"), (3, "word " * 9000), (4, "a  b\n\n\nc\t d <|endoftext|> e"), (5, "x" * 5000)]
    texts += [(10 + i, "same text here") for i in range(300)] + [(7, "again and again")] * 50
    df = spark.createDataFrame(texts, DOCS).selectExpr("*", "1 AS ids", "'r' AS route", "2 AS chunk", "3 AS place")
    assert checked(R.pack_documents(df).collect(), texts, plain) == 0


def test_empty_table(spark):
    assert R.pack_documents(spark.createDataFrame([], DOCS)).collect() == []


def test_small_shards_share_windows(spark, plain, monkeypatch):
    """Windows pass from one shard to the next, also where a shard has one document."""
    docs = [np.array([i, i + 1], np.uint16) for i in range(200)]
    idf = np.ones(R.VOCABULARY)
    packer = R.Packer(16, 0)
    for i in range(0, 200, 3):
        packer.fill(list(enumerate(docs))[i : i + 3], idf, 2.0)
    packer.finish()
    used = Counter()
    for _, _, length, _, _, sequence, _, _ in packer.rows:
        used[sequence] += length
    assert sum(used.values()) == 600 and sorted(used.values(), reverse=True) == [16] * 37 + [8]
