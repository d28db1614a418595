"""Best-fit packing of token sequences, after Martello-Toth dominance reduction.

Lengths are at most the capacity, so a histogram of them has `capacity` counters at most, however many documents there
are. The packing is worked out on that histogram, on the driver, in runs of equal bins; the pieces themselves only
learn their place in their length class, by a distributed rank, and look up their run. The result is what
the serial algorithm gives on all pieces.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm.common import bounded_batches, keep, kept, ranked, table, tidied, whole_ids
from tenura.llm.wordtable import WordTable, unit_slices

CAPACITY = 2048
#: Places for words, and ids, that a worker holds: 32 MB.
WORD_SLOTS, WORD_IDS = 1 << 20, 1 << 22
TOKENIZER = "word_bpe_49k.json"
END_ID = 0
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
IS_LOWER = (np.arange(256) >= 97) & (np.arange(256) <= 122)
IS_GAP = (np.arange(256) == 32) | (np.arange(256) == 10)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordCoder:
    """Token ids of texts as 16-bit numbers, by way of their words.

    No token spans an ASCII space or line feed (the tokenizer cuts at white space before it merges), a full stop or comma behind an
    ASCII letter at a word's end is a token of its own, and ASCII letters are lower-cased first; so a text's ids are those of its
    lower-cased words and marks in a row. New words are tokenized many at a time, with a separator word between them.
    """

    SEPARATOR = " \ue000 "

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
        self.tokenizer = Tokenizer.from_file(path)
        self.mark = np.array(self.tokenizer.encode(self.SEPARATOR, add_special_tokens=False).ids, np.uint16)
        self.table = WordTable(self._units, np.uint16, WORD_SLOTS, WORD_IDS)

    def _units(self, units: list[bytes], group: int = 256) -> tuple[np.ndarray, np.ndarray]:
        words = [u.decode() for u in units]
        groups = [words[a : a + group] for a in range(0, len(words), group)]
        coded = self.tokenizer.encode_batch_fast([self.SEPARATOR.join(g) for g in groups], add_special_tokens=False)
        parts, counts = [], []
        for own, code in zip(groups, coded):
            ids = np.array(code.ids, np.uint16)
            found = np.ones(max(0, len(ids) - len(self.mark) + 1), bool)
            for k, x in enumerate(self.mark):
                found &= ids[k : k + len(found)] == x
            cuts = np.flatnonzero(found)
            if len(cuts) != len(own) - 1:  # a word holds the separator itself
                alone = [c.ids for c in self.tokenizer.encode_batch_fast(own, add_special_tokens=False)]
                parts += [np.array(ids, np.uint16) for ids in alone]
                counts += map(len, alone)
                continue
            counts += (np.diff(cuts, prepend=-len(self.mark), append=len(ids)) - len(self.mark)).tolist()
            whole = np.ones(len(ids), bool)
            whole[(cuts[:, None] + np.arange(len(self.mark))).ravel()] = False
            parts.append(ids[whole])
        return np.concatenate(parts or [np.zeros(0, np.uint16)]), np.array(counts, np.int64)

    def texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of every text."""
        for _, _, buffer, gaps, _, bounds in unit_slices(texts, b" "):
            if b"<|" not in buffer.tobytes():  # a special token's text is matched as it stands
                buffer = LOWER[buffer]
            at = np.flatnonzero((buffer == 46) | (buffer == 44))
            after = np.append(buffer, 32)[at + 1]
            letter = IS_LOWER[buffer[at - 1]]  # every text begins with a space
            marks = at[letter & ((after == 32) | (after == 10))]
            starts = np.sort(np.concatenate([gaps + 1, marks]))
            ends = np.append(starts[1:] - IS_GAP[buffer[starts[1:] - 1]], len(buffer))
            ids, n = self.table.find(buffer, starts, ends)
            places = np.concatenate([[0], np.cumsum(n)])
            edges = places[np.searchsorted(starts, np.append(gaps, len(buffer))[bounds], side="left")]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                yield ids[a:b]


def coder(path: str) -> WordCoder:
    """One per Python worker, which serves many tasks."""
    return kept(("words", path), lambda: WordCoder(path))


def document_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and an end id, cut only beyond `capacity`.

    A null text counts as empty: one piece that holds the end id alone. Repeated rows give repeated pieces.
    """
    end = np.array([END_ID], np.uint16)

    def cut(frames):
        own = coder(path)
        for frame in frames:
            rows = []
            coded = own.texts([t if t is not None else "" for t in frame["text"]])
            for key, none, ids in zip(frame["doc_id"].tolist(), frame["null_id"].tolist(), coded):
                ids = np.concatenate([ids, end])
                for piece, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((key, none, piece, at, len(part), zlib.crc32(part.astype("<u4").tobytes())))
            yield pd.DataFrame(rows, columns=["doc_id", "null_id", "piece", "start", "length", "ids_crc32"])

    shape = "doc_id long, null_id boolean, piece int, start long, length long, ids_crc32 long"
    found = docs.select(*whole_ids("doc_id"), "text").mapInPandas(tidied(cut, keeps=True), shape)
    return found.withColumn("doc_id", F.when(~F.col("null_id"), F.col("doc_id"))).drop("null_id")


def reduced(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Take out, as (lengths of a bin, number of such bins), the sets that dominate every other set with their item.

    For an item j, taken from the longest down, with the shortest other items at hand:
    no other item fits beside it: {j} alone; an item that fills the bin to the brim exists, or no two others fit
    beside it: {j, the longest that fits}; two others fit but the longest single one is at least as long as the
    best pair together: {j, that one}. Such a bin is part of some optimal packing, so the rest may be packed as a
    smaller instance. Equal items are taken in bulk: removing copies never makes a rule fail that held before.
    `counts` (by length) is reduced in place.
    """
    bins: list[tuple[list[int], int]] = []

    def shortest_two(without: int) -> int:
        """The sum of the two shortest items once one copy of `without` is set aside; beyond capacity if none."""
        total = taken = 0
        for length in range(1, capacity + 1):
            free = int(counts[length]) - (length == without)
            use = min(2 - taken, max(0, free))
            total, taken = total + use * length, taken + use
            if taken == 2:
                return total
        return 2 * capacity + 1

    def longest_fit(j: int, room: int) -> int:
        for length in range(min(room, capacity), 0, -1):
            if counts[length] - (length == j) > 0:
                return length
        return 0

    def best_pair(j: int, room: int) -> int:
        present = [x for x in range(1, room) if counts[x] - (x == j) > 0]
        best, low, high = 0, 0, len(present) - 1
        while low <= high:
            a, b = present[low], present[high]
            if a + b > room or (low == high and counts[a] - (a == j) < 2):
                high -= 1
            else:
                best = max(best, a + b)
                low += 1
        return best

    for j in range(capacity, 0, -1):
        while counts[j] > 0:
            room = capacity - j
            other = longest_fit(j, room)
            if other == 0:
                bins.append(([j], int(counts[j])))
                counts[j] = 0
            elif other == room or shortest_two(j) > room or other >= best_pair(j, room):
                n = int(counts[j] // 2) if other == j else int(min(counts[j], counts[other]))
                bins.append(([j, other], n))
                counts[j] -= n
                counts[other] -= n
            else:
                break
    return bins


def packed_runs(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, items, first bin, items per bin, offset) that place a whole histogram; bins used.

    The item of rank r in its length class lies in bin first_bin + (r - first_rank) // per_bin, at
    offset + ((r - first_rank) % per_bin) * length.
    """
    counts = counts.astype(np.int64).copy()
    used = np.zeros_like(counts)
    runs: list[tuple[int, int, int, int, int, int]] = []
    bins = 0

    def place(length: int, first_bin: int, n_bins: int, per_bin: int, offset: int, items: int) -> None:
        runs.append((length, int(used[length]), items, first_bin, per_bin, offset))
        used[length] += items

    for lengths, n in reduced(counts, capacity):
        at = 0
        for length in lengths:
            place(length, bins, n, 1, at, n)
            at += length
        bins += n

    # Best fit, longest first. Equal open bins are kept as ranges by the room they have left.
    open_: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []

    def push(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_:
                open_[room] = []
                bisect.insort(rooms, room)
            open_[room].append((first, n))

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                per = min(capacity // length, left)
                n = left // per
                first, bins = bins, bins + n
                room = capacity
            else:
                room = rooms[at]
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
                per = min(room // length, left)
                fit = min(n, left // per)
                push(room, first + fit, n - fit)
                n = fit
            place(length, first, n, per, capacity - room, n * per)
            push(room - per * length, first, n)
            left -= n * per
    return np.array(runs, np.int64).reshape(-1, 6), bins


def pack(pieces: DataFrame, capacity: int = CAPACITY, key: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds `sequence_id` and `offset` to a stored table of pieces with a `length` in 1..capacity; keeps all columns."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[length] = n
    runs, _ = packed_runs(counts, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    before = np.concatenate([[0], np.cumsum(counts)])[: capacity + 1]  # ranks taken by shorter lengths
    spots = before[runs[:, 0]] + runs[:, 1]  # ascending: where each run starts in the order by length

    def placed(frames):
        for frame in frames:
            rank = frame["rank"].to_numpy()
            run = runs[np.searchsorted(spots, rank, side="right") - 1] if len(rank) else np.zeros((0, 6), np.int64)
            inside = rank - before[run[:, 0]] - run[:, 1]
            frame["sequence_id"] = run[:, 3] + inside // np.maximum(run[:, 4], 1)
            frame["offset"] = run[:, 5] + (inside % np.maximum(run[:, 4], 1)) * run[:, 0]
            yield frame.drop(columns="rank")

    order = ["length", *[k for k in key if k in pieces.columns]]
    out = ranked(pieces, order, "pieces-sorted")
    kept = [f for f in out.schema.fields if f.name != "rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"
    return out.select(*[f.name for f in kept], "rank").mapInPandas(placed, schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document with its place, in any order; sequences hold at most `capacity` tokens, without gaps."""
    bounded_batches(docs.sparkSession)
    return pack(keep(document_pieces(docs, path or tokenizer_path(), capacity), "pieces"), capacity)


def query(spark, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"))
