"""Importance resampling against plain n-grams and a plain draw."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from tenura.llm import resampling as R

DOCS = "doc_id long, text string"


def plain_features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    grams = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(g.encode()) % R.BUCKETS for g in grams]


def plain_resample(docs, target):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(plain_features(text)[1])
    for text in target:
        t.update(plain_features(text)[1])
    ss, tt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ss + 10000) / ((s[b] + 1) * (tt + 10000)))) for b in range(R.BUCKETS)}
    rows, fine = [], []
    for key, text in docs:
        n, buckets = plain_features(text)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([key, len(buckets), weight, score, None])
        if n >= 20:
            fine.append(rows[-1])
    fine.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for rank, row in enumerate(fine[: 5 * len(fine) // 100]):
        row[4] = rank + 1
    return sorted(map(tuple, rows), key=str)


def test_blocks_find_the_n_grams_of_whole_texts():
    rng = random.Random(1)
    alphabet = "abZé ü9.\n\x00\x7f日 -"
    for block in (1, 7, 1 << 20):
        for _ in range(100):
            texts = [None if rng.random() < 0.1 else "".join(rng.choices(alphabet, k=rng.choice([0, 3, 50, 200]))) for _ in range(5)]
            if rng.random() < 0.2:
                texts[0] = "x" * 200 + " " + "é" * 300 + " b " + "y" * 70
            got = [[] for _ in texts]
            words = [0] * len(texts)
            for docs, n, buckets in R.features(texts, block):
                for d, k, b in zip(docs.tolist(), n.tolist(), buckets.tolist()):
                    got[d].append(b)
                    words[d] += k == 1
            assert [(w, sorted(g)) for w, g in zip(words, got)] == [(n, sorted(f)) for n, f in map(plain_features, texts)]


def test_crc_of_a_concatenation():
    pairs = [(b"a", b"b"), (b"", b"xyz"), (b"word", b"q" * 63), (b"w", b"q" * 64), (b"w", b"q" * 5000)]
    first = np.array([zlib.crc32(a) for a, _ in pairs], np.uint32)
    then = np.array([zlib.crc32(b) for _, b in pairs], np.uint32)
    sizes = np.array([len(b) for _, b in pairs])
    assert R.followed(first, then, sizes).tolist() == [zlib.crc32(a + b" " + b) for a, b in pairs]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_table(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("text").collect()]
    got = rows_of(R.query(spark, folder))
    assert got == plain_resample(docs, target) and any(r[4] is not None for r in got)


def test_nulls_repeats_ties_and_long_texts(spark):
    rng = random.Random(2)
    words = ["alpha", "Beta", "gamma", "δέλτα", "x1", "日本"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 5, 19, 20, 30])))) for i in range(80)]
    docs += [(None, None), (None, " ".join(words * 5)), (3, ""), (200, None), (201, "long words " * 60000)] + docs[:20]
    target = ["alpha beta gamma", None, "", "x1 日本"]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "'a' AS rank", "1 AS weight", "2 AS down", "3 AS score")
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    assert rows_of(R.resample(df, bench)) == plain_resample(docs, target)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    docs = [(i, "one two three " * 10) for i in range(40)]
    assert R.resample(none, none).collect() == []
    assert rows_of(R.resample(spark.createDataFrame(docs, DOCS), none)) == plain_resample(docs, [])
