"""Lexical retrieval packing: windows of related documents, found by BM25 in a sharded inverted index.

Documents are tokenized once. The terms of the index are the distinct token ids of a document, so document frequencies are
exact over all documents and their table has the size of the vocabulary. Documents are ordered by a lexical
signature (their first tokens under fixed permutations), which brings alike ones together, and cut into shards of
bounded size; a group of copies of any size spans as many shards as it needs. Every shard has an inverted index of
its own. A window belongs to the document that opens it, its seed: unused neighbours of the seed are appended, best BM25 score
first, and the one that does not fit is cut, so that its rest opens the next window. Where no unused neighbour shares a
term with the seed, the next document in order follows. Windows pass from shard to shard; only the last one of a task stays
open, and it is cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm.common import bounded_batches, keep, table
from tenura.llm.counters import chunks, summed
from tenura.llm.wordtable import WordTable, unit_slices

CAPACITY = 1024
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
VOCABULARY = 50_257
SPECIAL = "<|endoftext|>"
END_ID = 0
#: A shard takes documents until it reaches one of these.
SHARD_DOCS = 2048
SHARD_TOKENS = 2_000_000
#: Terms of a seed that are looked up: those that weigh most.
QUERY_TERMS = 32
K1, B = 1.2, 0.75


class ByteCoder:
    """Token ids of texts as 16-bit numbers, by way of their words.

    The tokenizer cuts a text before the last white space of every run and then merges within the pieces alone, so a text cut
    before each space and line feed has the ids of its units in a row. New units are tokenized many at a time and cut
    apart by the bytes that tokens stand for; `ranks` give the same ids as the tokenizer. Texts with runs of three
    and more white spaces, with other white space at a unit's edge, or with the special token go to the tokenizer whole.
    """

    def __init__(self, path: str, ranks: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.whole = Tokenizer.from_file(path)
        self.encode = own.encode_ordinary
        self.bytes_of = np.zeros(VOCABULARY, np.int64)
        for token, rank in merges.items():
            self.bytes_of[rank] = len(token)
        self.alone = {s: np.array(self.encode(s), np.uint16) for s in (" ", "\n")}
        self.table = WordTable(self._units, np.uint16)

    def _units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [u.decode() for u in units]
        plain = [i for i, t in enumerate(texts) if len(t) > 1 and not t[1].isspace() and not t[-1].isspace() and SPECIAL not in t]
        found = np.array(self.encode("".join([texts[i] for i in plain])), np.uint16)
        sizes = np.array([len(units[i]) for i in plain], np.int64)
        ends = np.searchsorted(np.cumsum(self.bytes_of[found]), np.cumsum(sizes)) + 1
        counts = np.full(len(units), -1, np.int64)
        counts[plain] = np.diff(ends, prepend=0)
        if len(plain) == len(units):
            return found, counts
        parts = dict(zip(plain, np.split(found, ends[:-1]) if len(plain) else []))
        for i, t in enumerate(texts):
            if len(t) == 1:
                parts[i] = self.alone[t]
                counts[i] = len(parts[i])
        return np.concatenate([parts[i] for i in sorted(parts)] or [np.zeros(0, np.uint16)]), counts

    def texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of every text."""
        for first, last, buffer, starts, ends, bounds in unit_slices(texts, b"\n"):
            ids, n = self.table.find(buffer, starts, ends)
            lone = ends - starts == 1
            # A lone space or line feed is a token of its own only where no other stands beside it in its text.
            wrong = n < 0
            wrong[1:] |= lone[1:] & lone[:-1]
            inner = bounds[1:-1]
            wrong[inner] = n[inner] < 0  # the unit before belongs to another text
            wrongs = np.concatenate([[0], np.cumsum(wrong)])
            places = np.concatenate([[0], np.cumsum(np.maximum(n, 0))])
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                if wrongs[b] > wrongs[a]:
                    yield np.array(self.whole.encode(texts[first + i], add_special_tokens=False).ids, np.uint16)
                else:
                    yield ids[places[a] + len(self.alone["\n"]) : places[b]]


@functools.cache
def coder(path: str, ranks: str) -> ByteCoder:
    """One per Python worker, which serves many tasks."""
    return ByteCoder(path, ranks)


@functools.cache
def permutations(n: int = 3) -> np.ndarray:
    """Ranks of all ids under n fixed permutations; 16 bits each."""
    return np.stack([np.random.default_rng(k).permutation(VOCABULARY) for k in range(n)]).astype(np.uint16)


def terms(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and how often each occurs."""
    ordered = np.sort(ids, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])) if len(ids) else np.zeros(1, int)
    return ordered[edges[:-1]], np.diff(edges)


def tokenized(docs: DataFrame, path: str, ranks: str) -> DataFrame:
    """Two kinds of rows in one pass. Of every document (doc_id, tokens, route, ids): its length, signature and 16-bit ids.
    Of every task (chunk, counts): in how many of its documents each id occurs, and in the last place its tokens."""

    def run(batches):
        own, orders = coder(path, ranks), permutations()
        seen = np.zeros(VOCABULARY + 1, np.int64)
        for batch in batches:
            coded = list(own.texts([t or "" for t in batch.column("text").to_pylist()]))
            routes = []
            for ids in coded:
                kinds, _ = terms(ids)
                seen[kinds] += 1
                seen[-1] += len(ids)
                low = [int(kinds[np.argmin(o[kinds])]) for o in orders] if len(kinds) else [0] * len(orders)
                routes.append(functools.reduce(lambda x, y: x << 16 | y, low))
            sizes, data = [len(x) for x in coded], [x.tobytes() for x in coded]
            yield _frame(batch.column("doc_id"), sizes, routes, data, [-1] * len(coded), [None] * len(coded))
        parts = list(chunks(seen))
        none = [None] * len(parts)
        yield _frame(pa.array(none, pa.int64()), none, none, none, [c for c, _ in parts], [x for _, x in parts])

    def _frame(keys, sizes, routes, coded, chunk, counts):
        columns = [
            keys,
            pa.array(sizes, pa.int64()),
            pa.array(routes, pa.int64()),
            pa.array(coded, pa.binary()),
            pa.array(chunk, pa.int32()),
            pa.array(counts, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "tokens", "route", "ids", "chunk", "counts"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, tokens long, route long, ids binary, chunk int, counts binary")


def inverse_frequencies(seen: np.ndarray, n: int) -> np.ndarray:
    return np.log(1 + (n - seen + 0.5) / (seen + 0.5))


class Shard:
    """The inverted index of some documents: per term its documents and what the term adds to their score."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        found = [terms(x) for x in ids]
        sizes = np.array([len(k) for k, _ in found], np.int64)
        kinds = np.concatenate([k for k, _ in found]) if found else np.zeros(0, np.uint16)
        often = np.concatenate([c for _, c in found]).astype(float) if found else np.zeros(0)
        doc = np.repeat(np.arange(len(ids)), sizes)
        long = np.repeat(np.array([len(x) for x in ids], float), sizes) / max(mean, 1.0)
        gain = idf[kinds] * often * (K1 + 1) / (often + K1 * (1 - B + B * long))
        order = np.argsort(kinds, kind="stable")
        self.docs, self.gains = doc[order], gain[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(kinds, minlength=VOCABULARY))])
        self.size = len(ids)

    def scores(self, query: np.ndarray) -> np.ndarray:
        """BM25 of all documents of the shard for the query's terms."""
        spans = [slice(self.starts[t], self.starts[t + 1]) for t in query.tolist()]
        if not spans:
            return np.zeros(self.size)
        docs = np.concatenate([self.docs[s] for s in spans])
        return np.bincount(docs, np.concatenate([self.gains[s] for s in spans]), self.size)


def query_terms(ids: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The terms of a seed that weigh most, ties to smaller ids."""
    kinds, often = terms(ids)
    weight = idf[kinds] * often / (often + K1)
    return kinds[np.lexsort((kinds, -weight))[:QUERY_TERMS]]


class Packer:
    """Fills windows with documents and cuts the last one into powers of two."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.sequence = capacity, first
        self.room = capacity
        self.rows: list[tuple] = []
        self.open: list[tuple] = []  # what the unfinished window holds: (doc_id, start, ids, doc_tokens, score)
        self.seed: np.ndarray | None = None

    def _emit(self, key, start, ids, tokens, score, offset) -> None:
        crc = zlib.crc32(ids.astype("<u4").tobytes())
        self.rows.append((key, start, len(ids), crc, tokens, self.sequence, offset, score))

    def _close(self) -> None:
        offset = 0
        for key, start, ids, tokens, score in self.open:
            self._emit(key, start, ids, tokens, score, offset)
            offset += len(ids)
        self.open, self.room, self.seed = [], self.capacity, None
        self.sequence += 1

    def put(self, key, ids: np.ndarray, score: float | None) -> bool:
        """Append a document, its rest to new windows; whether a window was closed."""
        start, closed = 0, False
        while start < len(ids):
            take = min(self.room, len(ids) - start)
            if self.seed is None:
                self.seed = ids
            self.open.append((key, start, ids[start : start + take], len(ids), score))
            self.room -= take
            start += take
            if not self.room:
                self._close()
                closed = True
        return closed

    def finish(self) -> None:
        """Cut what is left into sequences of falling powers of two."""
        left = self.capacity - self.room
        todo, self.open = self.open, []
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            while size:
                key, start, ids, tokens, score = todo.pop(0)
                take = min(size, len(ids))
                self.open.append((key, start, ids[:take], tokens, score))
                if take < len(ids):
                    todo.insert(0, (key, start + take, ids[take:], tokens, score))
                size -= take
            self._close()

    def fill(self, shard: list[tuple], idf: np.ndarray, mean: float) -> None:
        """All documents (doc_id, ids) of a shard, in the order that retrieval gives them."""
        end = np.array([END_ID], np.uint16)
        index = Shard([ids for _, ids in shard], idf, mean)
        unused = np.ones(len(shard), bool)
        at = 0

        def take(i: int, score: float | None) -> bool:
            unused[i] = False
            return self.put(shard[i][0], np.concatenate([shard[i][1], end]), score)

        while True:
            while at < len(shard) and not unused[at]:
                at += 1
            if at == len(shard):
                return
            if self.seed is None:
                take(at, None)
                continue
            scores = np.where(unused, index.scores(query_terms(self.seed[:-1], idf)), 0.0)
            closed = False
            while not closed and (best := int(np.argmax(scores))) < len(scores) and scores[best] > 0:
                found, scores[best] = float(scores[best]), 0.0
                closed = take(best, found)
            while not closed:  # the shard has no neighbour left
                while at < len(shard) and not unused[at]:
                    at += 1
                if at == len(shard):
                    return
                closed = take(at, None)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bm25 double"


def pack(coded: DataFrame, idf: np.ndarray, mean: float, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of the stored rows (doc_id, tokens, route, ids).

    Shards are runs of the order by signature, so they hold alike documents and are of equal size whatever the signatures'
    skew. Equal rows differ by their place in the stored table. A task holds one shard at a time; sequence numbers start at
    the partition's number times 2 ** 40.
    """
    weights = coded.sparkSession.sparkContext.broadcast(idf)  # one number per id of the vocabulary

    def run(batches) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)
        shard: list[tuple] = []
        size = 0

        def rows():
            columns = list(zip(*packer.rows)) or [()] * 8
            packer.rows = []
            kinds = [pa.int64()] * 7 + [pa.float64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in PIECES.split(", ")])

        for batch in batches:
            for key, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                shard.append((key, np.frombuffer(data, np.uint16)))
                size += len(data) // 2
                if len(shard) >= SHARD_DOCS or size >= SHARD_TOKENS:
                    packer.fill(shard, weights.value, mean)
                    shard, size = [], 0
                    yield rows()
        packer.fill(shard, weights.value, mean)
        packer.finish()
        yield rows()

    place = coded.withColumn("place", F.monotonically_increasing_id())
    order = ["route", "doc_id", "place"]
    dealt = place.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("doc_id", "ids").mapInArrow(run, PIECES)


def pack_documents(
    docs: DataFrame, path: str | None = None, ranks: str | None = None, capacity: int = CAPACITY
) -> DataFrame:
    """One row per piece of every document of (doc_id, text); sequences hold at most `capacity` tokens, without gaps.

    `path` is the tokenizer's file and `ranks` the same vocabulary as ranks. Every document's ids are followed by an end id, so a
    null or empty text is one piece that holds the end id alone. Very long texts fill windows of their own; their rest
    seeds the next. Null ids stay null, and repeated rows are packed as often as they occur. Ties in score go to the
    document that comes first by signature, id and place in the table. An empty table gives no rows. Other columns, whatever
    their names, are not read. `bm25` is the score a piece's document was retrieved with; null for one that opened
    a window or followed for lack of neighbours.
    """
    import public_tokenizers

    bounded_batches(docs.sparkSession)
    own = tokenized(docs, path or public_tokenizers.path(TOKENIZER), ranks or public_tokenizers.path(RANKS))
    found = keep(own, "tokenized")
    seen = summed(found.where("chunk >= 0"), VOCABULARY + 1)
    coded = found.where("chunk < 0").select("doc_id", "tokens", "route", "ids")
    n = coded.count()
    return pack(coded, inverse_frequencies(seen[:-1], n), float(seen[-1]) / max(n, 1), capacity)


def query(spark, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"))
