"""Target-distribution importance resampling on hashed word n-grams.

Documents are drawn by how much likelier their n-grams are in a target collection than in the corpus. Both distributions
are counters over a fixed number of buckets; a document's weight is the sum of its n-grams' log ratios, and a
Gumbel variate drawn from its id turns the highest scores into a sample without replacement.

A batch's texts are joined into one byte buffer with a sentinel between them, a byte that UTF-8 never holds. One regex pass
finds all words and sentinels; the documents of words come from a binary search among the sentinels, and n-grams
whose words lie in two documents are masked before anything is counted. CRCs of n-grams are combined from
those of their words, so no n-gram is ever spelled out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.llm.common import bounded_batches, keep, ranked, slices, table
from tenura.llm.counters import chunks, summed

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Bytes of a buffer that are matched at a time; the last words of a block are carried into the next.
BLOCK = 1 << 20

SENTINEL = b"\xff"
TOKEN = re.compile(rb"[0-9a-z\x80-\xfe]+|\xff")
GAP = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]|\xff")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
DIRECT = 64


# CRC-32 of concatenations: the CRC of a + b is that of a, moved over the bytes of b, xor that of b.


@cache
def _byte_table() -> np.ndarray:
    """What one more zero byte makes of the low byte of a CRC register."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, np.uint32(0xEDB88320) ^ (x >> np.uint32(1)), x >> np.uint32(1))
    return x


def _moved_once(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint32(8)) ^ _byte_table()[x & np.uint32(255)]


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = tables[0][x & np.uint32(255)]
    for k in (1, 2, 3):
        out = out ^ tables[k][(x >> np.uint32(8 * k)) & np.uint32(255)]
    return out


@cache
def _direct() -> np.ndarray:
    """For each length below DIRECT and each byte of a register, the register moved by that many zero bytes."""
    x = np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None])
    out = [x]
    for _ in range(1, DIRECT):
        out.append(_moved_once(out[-1]))
    return np.stack(out)


@cache
def _doubled() -> list[np.ndarray]:
    """The same for lengths of 1, 2, 4, ... bytes."""
    out = [_direct()[1]]
    for _ in range(40):
        out.append(_apply(out[-1], out[-1]))
    return out


def moved(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The registers moved over `lengths` zero bytes."""
    flat = _direct().reshape(-1)
    at = (np.minimum(lengths, DIRECT - 1) * 1024).astype(np.int64)
    out = flat[at + (crc & np.uint32(255))]
    for k in (1, 2, 3):
        out ^= flat[at + 256 * k + ((crc >> np.uint32(8 * k)) & np.uint32(255))]
    long = np.flatnonzero(lengths >= DIRECT)
    if len(long):
        x, left = crc[long].copy(), lengths[long]
        for bit, tables in enumerate(_doubled()):
            on = (left >> bit) & 1 == 1
            if on.any():
                x[on] = _apply(tables, x[on])
        out[long] = x
    return out


def followed(first: np.ndarray, then: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC of a + " " + b from those of a and b and the length of b in bytes."""
    spaced = _moved_once(first) ^ np.uint32(zlib.crc32(b" "))
    return moved(spaced, lengths) ^ then


def features(texts: list[str | None], block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (document, words of the n-gram, bucket) of all n-grams of a batch, in no particular order.

    A block takes about `block` bytes of the joined texts, whole words always; the last two words and the number of
    sentinels so far are carried over, so blocks cut through texts without losing or inventing an n-gram.
    """
    data = SENTINEL.join((t or "").encode() for t in texts).translate(LOWER)
    done = at = 0
    crc_before, size_before, doc_before = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    while at < len(data):
        end = min(at + block, len(data))
        if end < len(data):
            gap = GAP.search(data, end)
            end = gap.start() if gap else len(data)
        tokens = TOKEN.findall(data, at, end)
        at = end
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        crcs = np.fromiter(map(zlib.crc32, tokens), np.uint32, len(tokens))
        ends = np.flatnonzero((sizes == 1) & (crcs == np.uint32(zlib.crc32(SENTINEL))))
        words = np.ones(len(tokens), bool)
        words[ends] = False
        docs = done + np.searchsorted(ends, np.flatnonzero(words))  # sentinels before a word
        done += len(ends)
        crc = np.concatenate([crc_before, crcs[words]])
        size = np.concatenate([size_before, sizes[words]])
        doc = np.concatenate([doc_before, docs])
        old = len(crc_before)
        gram = crc
        yield doc[old:], np.ones(len(doc) - old, np.int8), (crc[old:] % np.uint32(BUCKETS)).astype(np.int64)
        for n in range(2, LONGEST + 1):  # gram[i]: the n-gram that ends at word i + n - 1
            gram = followed(gram[: len(crc) - n + 1], crc[n - 1 :], size[n - 1 :])
            whole = doc[: len(gram)] == doc[n - 1 :]
            whole[: max(0, old - n + 1)] = False  # ended in the block before
            yield doc[n - 1 :][whole], np.full(int(whole.sum()), n, np.int8), (gram[whole] % np.uint32(BUCKETS)).astype(np.int64)
        crc_before, size_before, doc_before = (x[len(x) - min(len(x), LONGEST - 1) :] for x in (crc, size, doc))


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket's n-grams occur in the column `text` of all rows."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            own = batch.column("text").to_pylist()
            for a, b in slices(own):
                for _, _, bucket in features(own[a:b]):
                    counts += np.bincount(bucket, minlength=BUCKETS)
        rows = list(chunks(counts))
        yield pa.RecordBatch.from_pydict(
            {"chunk": pa.array([r[0] for r in rows], pa.int32()), "counts": pa.array([r[1] for r in rows], pa.binary())}
        )

    return summed(texts.select("text").mapInArrow(run, "chunk int, counts binary"), BUCKETS)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the log ratio of its smoothed share in the target to that in the corpus, in thousandths, floored."""
    s, t = corpus.astype(float), target.astype(float)
    ratio = (t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    table_ = docs.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers

    def run(batches):
        for batch in batches:
            own = batch.column("text").to_pylist()
            n = np.zeros((LONGEST + 1, len(own)), np.int64)
            weight = np.zeros(len(own), np.int64)
            for a, b in slices(own):
                for doc, length, bucket in features(own[a:b]):
                    if not len(doc):
                        continue
                    # Words come in text order, so a document's features are a run of the block.
                    sums = np.concatenate([[0], np.cumsum(table_.value[bucket])])
                    edges = np.searchsorted(doc, np.arange(b - a + 1))
                    weight[a:b] += sums[edges[1:]] - sums[edges[:-1]]
                    n[length[0], a:b] += np.diff(edges)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n[1]), pa.array(n.sum(axis=0)), pa.array(weight)],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(key: Column, seed: int = SEED) -> Column:
    """A Gumbel variate in thousandths, floored, from the first 32 bits of sha256 of "seed:key"."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of (doc_id, text); drawn rows have a rank from 1.

    `target` needs a column `text`. `percent` of the rows with at least `least` words are drawn, highest scores first, ties to
    smaller ids. Null and empty texts have no features, weight 0, and are never drawn; an empty target leaves
    every bucket at its smoothed share. A null id takes noise from an empty key and ties after all others. Repeated rows are rows
    of their own: equal ids have equal noise, and their ties fall by n_features and weight. Very long texts are matched in
    blocks. Empty tables give no rows. Other columns, whatever their names, are not read.
    """
    bounded_batches(docs.sparkSession)
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = keep(weights(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weights")
    fine = scored.where(F.col("n_words") >= least).withColumns(
        {"down": -F.col("score"), "no_id": F.col("doc_id").isNull().cast("int")}
    )
    placed = ranked(fine, ["down", "no_id", "doc_id", "n_features", "weight"], "drawn")
    drawn = fine.count() * percent // 100
    place = F.when(F.col("rank") < drawn, F.col("rank") + 1).cast("long")
    names = ["doc_id", "n_features", "weight", "score"]
    rest = scored.where(F.col("n_words") < least)
    return placed.select(*names, place.alias("rank")).unionByName(rest.select(*names, F.lit(None).cast("long").alias("rank")))


def query(spark, folder: str) -> DataFrame:
    return resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
