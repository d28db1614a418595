"""SentencePiece encoding with seeded merge dropout, and lossless decoding.

A text's symbols are merged through an agenda, best score first. Each candidate that comes up is skipped with the given
probability, drawn by a hash of the seed, the document, the chunk's place in it and the candidate's number. So the same seed
always gives the same segmentation, other seeds give others, and every occurrence of a word has its own. All of them decode
to the same text.

A chunk's segmentation depends only on which of its candidates are skipped. Per chunk a tree of these choices is kept: an
occurrence draws its skips as gaps between them and walks down, and only choices not met before are segmented.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm.common import bounded_batches, lists, mixed, slices, table, whole_ids

MODEL = "piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 1
CACHE_NODES = 1_000_000
#: Characters that are segmented together: the more, the more chunks of one length advance at a time.
SLICE = 3_000_000
#: Candidates that come up in a chunk of n characters: n - 1 at first and at most two more after each merge. Up to this length
#: they fit a mask of 64 bits.
LONGEST_CACHED = 22
#: A drawn gap of this size says that so many candidates are not skipped, and the next draw goes on from there.
GAP = 64
SPACE = "▁"
#: No piece holds a space behind another character, and none holds a line feed: merges never cross these cuts.
CHUNKS = re.compile(r"\n| *[^ \n]+| +")
_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def chunk_salts(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The hash that a chunk's skips are drawn from: of its text's key and its place there."""
    return mixed(mixed(keys) + places.astype(np.uint64) * np.uint64(_STEP))


@functools.cache
def gap_limits(dropout: float) -> np.ndarray:
    """Ascending limits: a uniform 64-bit number is below as many of them as candidates pass before the next skip."""
    out, stay = [], 1.0
    for _ in range(GAP):
        stay *= max(0.0, 1.0 - dropout)
        out.append(min(int(stay * 2.0**64), _MASK))
    return np.array(out[::-1], np.uint64)


def gaps(salts: np.ndarray, draw: int, limits: np.ndarray) -> np.ndarray:
    numbers = mixed(salts + np.uint64((draw + 1) * _STEP & _MASK))
    return GAP - np.searchsorted(limits, numbers, side="right")


def decisions(salt: int, dropout: float) -> Iterator[bool]:
    """Whether each candidate that comes up is skipped, one after the other."""
    if dropout <= 0:
        yield from itertools.repeat(False)
    limits, salts = gap_limits(dropout), np.array([salt], np.uint64)
    for draw in itertools.count():
        gap = int(gaps(salts, draw, limits)[0])
        yield from itertools.repeat(False, gap)
        if gap < GAP:
            yield True


class PieceCoder:
    """Encoder and decoder over a BPE model with byte fallback. A chunk is segmented once per set of skips while it is cached."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes_: dict[int, int] = {}
        self.pieces: dict[str, tuple[float, int]] = {}
        self.plain: list[bytes] = []
        for i, name in enumerate(self.names):
            if model.is_byte(i):
                self.bytes_[int(name[3:5], 16)] = i
                self.plain.append(bytes([int(name[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.plain.append(b"")
            else:
                self.pieces[name] = (model.get_score(i), i)
                self.plain.append(name.replace(SPACE, " ").encode())
        self.symbols = np.full(0x110000, -1, np.int32)
        for name, (_, i) in self.pieces.items():
            if len(name) == 1 and name != SPACE:
                self.symbols[ord(name)] = i
        self.symbols[ord(" ")] = self.pieces[SPACE][1]
        pairs = {}
        for name, (score, i) in self.pieces.items():
            for k in range(1, len(name)):
                if name[:k] in self.pieces and name[k:] in self.pieces:
                    pairs[self.pieces[name[:k]][1] << 32 | self.pieces[name[k:]][1]] = score, i
        self.pairs = np.array(sorted(pairs), np.int64)
        self.scores = np.array([pairs[x][0] for x in self.pairs.tolist()])
        self.merged = np.array([pairs[x][1] for x in self.pairs.tolist()], np.int32)
        self._clear()

    def _clear(self) -> None:
        """Empty the trees. A node is a chunk with a set of skipped candidates; roots skip none."""
        self.roots: dict[str, int] = {}
        self.children: dict[int, int] = {}
        self.chunks: list[str] = []
        self.found: list[bytes] = []
        self.masks = np.zeros(0, np.uint64)
        self.used = np.zeros(0, np.int64)

    def segment(self, chunk: str, salt: int = 0, dropout: float = 0.0) -> list[int]:
        """Ids of one chunk. Of the candidates that come up, those of `decisions(salt, dropout)` are skipped.

        A literal U+2581 is no space: it is written as its bytes, so that it survives the way back.
        """
        symbols = [None if c == SPACE else SPACE if c == " " else c for c in chunk]
        n = len(symbols)
        following, preceding = list(range(1, n + 1)), list(range(-1, n - 1))
        skipped = decisions(salt, dropout)
        agenda: list[tuple[float, int, int, str]] = []
        pieces = self.pieces

        def propose(left: int) -> None:
            if left < 0:
                return
            right = following[left]
            if right < n and symbols[left] is not None and symbols[right] is not None:
                both = symbols[left] + symbols[right]
                if both in pieces:
                    heapq.heappush(agenda, (-pieces[both][0], left, right, both))

        for i in range(n - 1):
            propose(i)
        while agenda:
            _, left, right, both = heapq.heappop(agenda)
            # Stale if either symbol has been merged away or has grown since.
            if symbols[left] is None or symbols[right] is None or following[left] != right:
                continue
            if len(symbols[left]) + len(symbols[right]) != len(both):
                continue
            if next(skipped):
                continue
            symbols[left], symbols[right] = both, None
            after = following[right]
            following[left] = after
            if after < n:
                preceding[after] = left
            following[right] = -1
            propose(preceding[left])
            propose(left)
        out, at = [], 0
        while at < n:
            symbol = symbols[at]
            if symbol is not None and symbol in pieces:
                out.append(pieces[symbol][1])
            else:
                out.extend(self.bytes_[b] for b in (SPACE if symbol is None else symbol).encode())
            at = following[at]
        return out

    def segment_many(self, chunks: list[str], masks: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Ids of many chunks as bytes, and how many candidates came up in each. Bit t of a mask skips the t-th of them.

        Chunks of one length advance together, a merge each at a time. The agenda's next entry is the best of the pairs
        at hand, the leftmost among equals.
        """
        out: list[bytes] = [b""] * len(chunks)
        used = np.zeros(len(chunks), np.int64)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4")
        starts = np.cumsum(sizes) - sizes
        for n in np.unique(sizes).tolist():
            places = np.flatnonzero(sizes == n)
            ids = self.symbols[points[starts[places][:, None] + np.arange(n)]]
            # A character without a piece stands as its place, below zero; no pair holds it.
            ids = np.where(ids >= 0, ids, -1 - np.arange(n, dtype=np.int32))
            self._advance(ids, places, chunks, masks, out, used)
        return out, used

    def _advance(self, ids, rows, chunks, masks, out: list[bytes], used: np.ndarray) -> None:
        def candidates(left, right):
            """Merged ids and scores of pairs; minus infinity where there is none."""
            pair = left.astype(np.int64) << 32 | right
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            return self.merged[at], np.where(self.pairs[at] == pair, self.scores[at], -np.inf)

        def emit(row: np.ndarray, chunk: str) -> bytes:
            whole = [[i] if i >= 0 else [self.bytes_[b] for b in chunk[-1 - i].encode()] for i in row.tolist()]
            return np.array(list(itertools.chain.from_iterable(whole)), "<u4").tobytes()

        masks = masks[rows]
        into, score = candidates(ids[:, :-1], ids[:, 1:])
        while len(rows):
            best = np.zeros(len(rows), np.int64)
            open_ = np.zeros(len(rows), bool)
            line = np.arange(len(rows)) if score.shape[1] else np.zeros(0, np.int64)
            while len(line):  # until every row has a candidate that is not skipped, or none at all
                best[line] = score[line].argmax(1)
                line = line[score[line, best[line]] > -np.inf]
                skip = (masks[line] >> used[rows[line]].astype(np.uint64) & np.uint64(1)).astype(bool)
                used[rows[line]] += 1
                open_[line[~skip]] = True
                line = line[skip]
                score[line, best[line]] = -np.inf
            done = np.flatnonzero(~open_)
            width = 4 * ids.shape[1]
            data = ids[done].astype("<u4").tobytes()
            plain = (ids[done] >= 0).all(1).tolist()
            for k, i in enumerate(rows[done].tolist()):
                out[i] = data[k * width : (k + 1) * width] if plain[k] else emit(ids[done[k]], chunks[i])
            if not open_.any():
                return
            ids, rows, masks = ids[open_], rows[open_], masks[open_]
            into, score, best = into[open_], score[open_], best[open_]
            line = np.arange(len(rows))
            ids[line, best] = into[line, best]

            def without(x, gone):
                mask = np.ones(x.shape, bool)
                mask[line, gone] = False
                return x[mask].reshape(len(x), -1)

            ids = without(ids, best + 1)
            into, score = without(into, best), without(score, best)
            for shift in (-1, 0):  # the pairs on both sides of the merged symbol
                at = best + shift
                some = np.flatnonzero((at >= 0) & (at < ids.shape[1] - 1))
                at = at[some]
                into[some, at], score[some, at] = candidates(ids[some, at], ids[some, at + 1])

    def _grow(self, chunks: list[str], masks: np.ndarray) -> range:
        """New nodes."""
        found, used = self.segment_many(chunks, masks)
        first = len(self.found)
        self.chunks += chunks
        self.found += found
        self.masks, self.used = np.concatenate([self.masks, masks]), np.concatenate([self.used, used])
        return range(first, len(self.found))

    def _walk(self, nodes: np.ndarray, salts: np.ndarray, dropout: float) -> None:
        """Take every occurrence from its root to the node of its own skips; places below zero have no tree."""
        limits = gap_limits(dropout)
        live = np.flatnonzero(nodes >= 0)
        at = np.zeros(len(live), np.int64)
        draw = 0
        while len(live):
            at += gaps(salts[live], draw, limits)  # GAP is beyond any candidate of a cached chunk
            hit = at < self.used[nodes[live]]
            live, at = live[hit], at[hit]
            wanted, back = np.unique(nodes[live] << 6 | at, return_inverse=True)
            keys = wanted.tolist()
            new = [k for k in keys if k not in self.children]
            if new:
                masks = self.masks[[k >> 6 for k in new]] | np.uint64(1) << np.array([k & 63 for k in new], np.uint64)
                self.children.update(zip(new, self._grow([self.chunks[k >> 6] for k in new], masks)))
            nodes[live] = np.array([self.children[k] for k in keys], np.int64)[back]
            at += 1
            draw += 1

    def texts(self, texts: list[str | None], keys: list[int], dropout: float = 0.0) -> Iterator[bytes]:
        """Ids of every text as little-endian 32-bit numbers. An empty text has none; else a space is put in front.

        A chunk's skips are drawn by the text's key and the chunk's place in the text.
        """
        for start, end in slices(texts, SLICE):
            if len(self.found) > CACHE_NODES:
                self._clear()
            split = [CHUNKS.findall(" " + t) if t else [] for t in texts[start:end]]
            flat = list(itertools.chain.from_iterable(split))
            sizes = np.array([len(x) for x in split], np.int64)
            new = list(set(flat).difference(self.roots))
            short = [c for c in new if len(c) <= LONGEST_CACHED]
            self.roots.update(zip(short, self._grow(short, np.zeros(len(short), np.uint64))))
            long = [c for c in new if len(c) > LONGEST_CACHED]
            self.roots.update(dict.fromkeys(long, -1))
            nodes = np.fromiter(map(self.roots.__getitem__, flat), np.int64, len(flat))
            for c in long:
                del self.roots[c]
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            salts = chunk_salts(np.repeat(np.array([k & _MASK for k in keys[start:end]], np.uint64), sizes), place)
            if dropout > 0:
                self._walk(nodes, salts, dropout)
            found = self.found
            ids = [found[k] if k >= 0 else b"" for k in nodes.tolist()]
            for i in np.flatnonzero(nodes < 0).tolist():
                ids[i] = np.array(self.segment(flat[i], int(salts[i]), dropout), "<u4").tobytes()
            at = 0
            for n in sizes.tolist():
                yield b"".join(ids[at : at + n])
                at += n

    def encode(self, text: str, key: int = 0, dropout: float = 0.0) -> bytes:
        return next(self.texts([text], [key], dropout))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, whichever merges were skipped. Control pieces are empty; broken UTF-8 is replaced."""
        data = b"".join(map(self.plain.__getitem__, ids.tolist()))
        return data[1:].decode(errors="replace") if data[:1] == b" " else data.decode(errors="replace")


@functools.cache
def coder(path: str) -> PieceCoder:
    """One per Python worker, which serves many tasks."""
    return PieceCoder(path)


def document_keys(seed: int, doc_ids: list[int]) -> list[int]:
    """The hash key of every document: of the seed and its id."""
    start = mixed(np.array([seed & _MASK], np.uint64))
    return mixed(start + np.array([k & _MASK for k in doc_ids], np.uint64) * np.uint64(_STEP)).tolist()


def _coded(docs: DataFrame, path: str, dropout: float, seed: int, shape: str, finish) -> DataFrame:
    """Encode every row and let `finish(coder, texts, ids)` make the columns after the key."""

    def run(batches):
        own = coder(path)
        for batch in batches:
            texts, keys = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            none = batch.column("null_id")
            for a, b in slices(texts, SLICE):
                ids = list(own.texts(texts[a:b], document_keys(seed, keys[a:b]), dropout))
                names, columns = finish(own, texts[a:b], ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[a:b], pa.int64()), none.slice(a, b - a), *columns], ["doc_id", "null_id", *names]
                )

    rows = docs.select(*whole_ids("doc_id"), "text")
    out = rows.mapInArrow(run, "doc_id long, null_id boolean, " + shape)
    return out.withColumn("doc_id", F.when(~F.col("null_id"), F.col("doc_id"))).drop("null_id")


def encode_documents(
    docs: DataFrame, path: str | None = None, dropout: float = DROPOUT, seed: int = SEED
) -> DataFrame:
    """(doc_id, ids) of every row. A null or empty text has no ids."""
    return _coded(
        docs, path or model_path(), dropout, seed, "ids array<int>",
        lambda _, texts, ids: (["ids"], [lists([np.frombuffer(x, "<u4") for x in ids], np.int32)]),
    )


def decode_column(ids, path: str | None = None):
    """The text of an array of ids; null for null."""
    place = path or model_path()

    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = coder(place)
        for batch in batches:
            yield pd.Series([None if x is None else own.decode(np.asarray(x, np.int64)) for x in batch], dtype=object)

    decode.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(decode, "string")(ids)


def digests(docs: DataFrame, path: str | None = None, dropout: float = DROPOUT, seed: int = SEED):
    """(doc_id, n_pieces, ids_crc32, decoded_crc32, lossless): encoded, decoded again and compared, row by row."""

    def finish(own, texts, ids):
        back = [own.decode(np.frombuffer(x, "<u4")) for x in ids]
        columns = {
            "n_pieces": pa.array([len(x) // 4 for x in ids], pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64()),
            "decoded_crc32": pa.array([zlib.crc32(x.encode()) for x in back], pa.int64()),
            "lossless": pa.array([x == (t or "") for x, t in zip(back, texts)], pa.bool_()),
        }
        return list(columns), list(columns.values())

    shape = "n_pieces long, ids_crc32 long, decoded_crc32 long, lossless boolean"
    return _coded(docs, path or model_path(), dropout, seed, shape, finish)


def query(spark, folder: str) -> DataFrame:
    bounded_batches(spark)
    return digests(table(spark, folder, "documents"))
