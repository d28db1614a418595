"""Exact n-gram Jaccard join with set relations.

Every document is the set of its distinct word shingles; two documents link when the sets' Jaccard similarity reaches the
threshold. Equal sets are one set. Of the others, each is indexed under its prefix only: its rarest shingles, as many as
it takes for two linked sets to share one. What keeps the index lists from being expanded into pairs:

- Index-level skipping. Lists are sorted by set size and position. A block of a list whose sizes and positions cannot
  reach the needed overlap is passed over as a whole.
- Answer-level skipping. Of a list, first only its hub is verified against the others: the set that has the list's
  shingle at the lowest position, so the one with fewest rare shingles of its own. Answers of
  two sets similar to the hub are then derived from their overlaps with it: |x & y| lies between
  o(x) + o(y) - |hub| and min(o(y) + |x| - o(x), o(x) + |y| - o(y)). Sets that are connected already need no
  answer; only pairs that the bounds leave open are verified, and of those only the ones whose bitmaps (of fixed size)
  allow the needed overlap: bits that differ are shingles that differ.

The order of shingles (rarest first) comes from a frequency sketch of fixed size. It decides what the work costs, never
what is found.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm.common import bounded_batches, components, keep, lists, mixed, slices, table, tidied, whole_ids
from tenura.llm.hashing import LOWER_ASCII, joined, words_of

WORDS = 4
PERCENT = 85
SKETCH = 1 << 20
CHUNK = 1 << 12
WINDOW = 3_000_000
LANE = 1 << 15
BLOCK = 64
BITMAP = 1 << 24
#: Pairs that leave a task in one batch.
PAIRS = 100_000
#: Characters whose shingles are held at a time.
SLICE = 400_000
#: Bits of a set's bitmap: four for each shingle, rounded up to a power of two between these. A full bitmap would rule out nothing.
BITS, MOST_BITS = 1 << 11, 1 << 18

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Per text its distinct shingles as sorted 64-bit hashes; fewer words than a shingle make one, none make none."""
    buffer, text_starts = joined(texts, LOWER_ASCII)
    starts, _, hashes = words_of(buffer)
    bounds = np.searchsorted(starts, text_starts)
    grams = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        grams += hashes[k : k + len(grams)] * _MULTIPLIERS[k]
    grams = mixed(grams + np.uint64(words))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            short = (hashes[a:b] * _MULTIPLIERS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mixed(np.array([short])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    return tuple(int(mixed(s ^ m).sum(dtype=np.uint64).astype(np.int64)) for m in _MULTIPLIERS[4:6])


def needed(n, m, percent: int = PERCENT):
    """The smallest overlap with which sets of sizes n and m link."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def profiles(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One pass over the texts, two kinds of rows.

    Of every document (doc_id, n, f1, f2): the set's size and fingerprint. Of every task, (chunk, counts): its part of
    the frequency sketch, which counts the shingles that occur twice or more within a window of the task. A shingle
    that is in more documents than there are windows is seen for certain.
    """

    def run(frames):
        sketch = np.zeros(SKETCH, np.int64)
        window: list[np.ndarray] = []
        size = 0

        def count():
            nonlocal size
            if size:
                tokens = np.sort(np.concatenate(window))
                edges = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1], [True]]))
                n = np.diff(edges)
                twice = n > 1
                np.add.at(sketch, (tokens[edges[:-1]][twice] & np.uint64(SKETCH - 1)).astype(np.int64), n[twice])
            window.clear()
            size = 0

        for frame in frames:
            texts = [t if isinstance(t, str) else None for t in frame["text"]]
            rows = []
            for a, b in slices(texts, SLICE):
                for s in shingle_sets(texts[a:b], words):
                    rows.append((len(s), *_fingerprint(s)))
                    window.append(s)
                    size += len(s)
                if size > WINDOW:
                    count()
            out = pd.DataFrame(rows, columns=["n", "f1", "f2"])
            out["doc_id"], out["null_id"] = frame["doc_id"].to_numpy(), frame["null_id"].to_numpy()
            yield out.assign(chunk=-1, counts=b"")
        count()
        for chunk in range(SKETCH // CHUNK):
            part = np.minimum(sketch[chunk * CHUNK : (chunk + 1) * CHUNK], (1 << 31) - 1)
            if part.any():
                yield pd.DataFrame(
                    {"n": [0], "f1": 0, "f2": 0, "doc_id": 0, "null_id": True, "chunk": chunk, "counts": [part.astype("<i4").tobytes()]}
                )

    found = docs.select(*whole_ids("doc_id"), "text").mapInPandas(
        tidied(run), "doc_id long, null_id boolean, n int, f1 long, f2 long, chunk int, counts binary"
    )
    return found.withColumn("doc_id", F.when(~F.col("null_id"), F.col("doc_id"))).drop("null_id")


def frequency_sketch(found: DataFrame) -> np.ndarray:
    """The tasks' sketches summed; `SKETCH` counters whatever the input's size."""

    def add(frames):
        total: dict[int, np.ndarray] = {}
        for frame in frames:
            for chunk, counts in zip(frame["chunk"].tolist(), frame["counts"]):
                own = total.setdefault(chunk, np.zeros(CHUNK, np.int64))
                own += np.frombuffer(counts, "<i4")
        rows = [(c, np.minimum(x, (1 << 31) - 1).astype("<i4").tobytes()) for c, x in total.items()]
        yield pd.DataFrame(rows, columns=["chunk", "counts"])

    parts = found.where("chunk >= 0").select("chunk", "counts").repartition("chunk")
    sketch = np.zeros(SKETCH, np.int32)
    for row in parts.mapInPandas(add, "chunk int, counts binary").collect():
        sketch[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(row.counts, "<i4")
    return sketch


def prefixes(docs: DataFrame, sketch, words: int, percent: int, lane: int) -> DataFrame:
    """(n, f1, f2, id, tokens): of every distinct set its prefix, rarest first, under the smallest doc_id that has it."""

    def run(batches):
        counts = sketch.value
        for batch in batches:
            texts, keys = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in slices(texts, SLICE):
                own = [(key, x) for key, x in zip(keys[a:b], shingle_sets(texts[a:b], words)) if len(x)]
                tokens, lanes = [], []
                for _, x in own:
                    weight = counts[(x & np.uint64(SKETCH - 1)).astype(np.int64)]
                    first = np.lexsort((x, weight))[: prefix_length(len(x), percent)]
                    tokens.append(x[first].view(np.int64))
                    lanes.append(weight[first] // lane + 1)
                marks = np.array([_fingerprint(x) for _, x in own], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([len(x) for _, x in own], pa.int32()),
                        pa.array(marks[:, 0]),
                        pa.array(marks[:, 1]),
                        pa.array([key for key, _ in own], pa.int64()),
                        lists(tokens, np.int64),
                        lists(lanes, np.int32),
                    ],
                    ["n", "f1", "f2", "id", "tokens", "lanes"],
                )

    shape = "n int, f1 long, f2 long, id long, tokens array<long>, lanes array<int>"
    slim = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    each = slim.mapInArrow(tidied(run), shape)
    best = each.groupBy("n", "f1", "f2").agg(F.min(F.struct("id", "tokens", "lanes")).alias("best"))
    return best.select("n", "best.id", "best.tokens", "best.lanes")


def postings(sets: DataFrame) -> DataFrame:
    """(token, lane, lanes, n, pos, id). A token in very many sets is dealt to several lanes by a hash of the id."""
    each = sets.select("id", "n", F.posexplode(F.arrays_zip("tokens", "lanes")).alias("pos", "x"))
    lane = F.pmod(F.xxhash64("id"), F.col("x.lanes")).cast("int")
    return each.select(F.col("x.tokens").alias("token"), lane.alias("lane"), F.col("x.lanes").alias("lanes"), "n", "pos", "id")


def open_pair(n, pos, m, at, percent):
    """Whether sets of these sizes, which share a token at these positions and none before, can still link."""
    rest = np.minimum(n - pos, m - at)
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (rest >= needed(n, m, percent))


def _partnered(ids, n, pos, starts, sizes, percent) -> np.ndarray:
    """Which members of the lists (0 in `sizes`: not of this one) form an open pair with another than their hub, the list's first."""
    others = np.maximum(sizes - 1, 0)
    each = np.repeat(others, others)  # of every such member, the members it is held against
    first = np.repeat(starts + 1, others)
    member = first + np.arange(len(each)) - np.repeat(np.cumsum(others) - others, others)
    p = np.repeat(member, each)
    q = np.repeat(first, each) + np.arange(len(p)) - np.repeat(np.cumsum(each) - each, each)
    fits = (ids[p] != ids[q]) & open_pair(n[p], pos[p], n[q], pos[q], percent)
    out = np.zeros(len(ids), bool)
    out[p[fits]] = True
    return out


def _stars(percent: int, level: int):
    """Runs of one token and lane, sorted: the pairs of each list's hub, and the lists that can hold more than these.

    Of a short list only the members stay that can link with another than the hub. Random texts share a shingle now and then, the
    more often the more texts there are; hardly any of them could link.
    """
    fields = ["token", "lane", "lanes", "n", "pos", "id"]

    def work(x: dict[str, np.ndarray]):
        edge = (x["token"][1:] != x["token"][:-1]) | (x["lane"][1:] != x["lane"][:-1])
        starts = np.concatenate([[0], np.flatnonzero(edge) + 1])
        sizes = np.diff(np.concatenate([starts, [len(edge) + 1]]))
        hub = np.repeat(starts, sizes)
        ids, n, pos = x["id"], x["n"], x["pos"]
        good = np.flatnonzero((ids != ids[hub]) & open_pair(n, pos, n[hub], pos[hub], percent))
        distinct = np.unique(np.column_stack([ids[good], ids[hub[good]], n[good], n[hub[good]]]), axis=0)
        laned = (x["lanes"][starts] > 1) & (level == 0)
        left = np.repeat((sizes > BLOCK) | laned, sizes)
        left |= _partnered(ids, n, pos, starts, np.where((sizes > 2) & (sizes <= BLOCK) & ~laned, sizes, 0), percent)
        upto = np.concatenate([[0], np.cumsum(left)])
        large = np.flatnonzero(upto[starts + sizes] > upto[starts])
        head = starts[large]
        spans = [slice(a, b) for a, b in zip(upto[head].tolist(), upto[head + sizes[large]].tolist())]
        k, zero, none = len(distinct), np.zeros(len(distinct), np.int64), [np.zeros(0)] * len(distinct)
        numbers = {
            "kind": (zero, np.ones(len(large))),
            "token": (zero, x["token"][head]),
            "lane": (zero, x["lane"][head]),
            "lanes": (zero, x["lanes"][head]),
            "a": (distinct[:, 0], np.zeros(len(large))),
            "b": (distinct[:, 1], ids[head]),
            "na": (distinct[:, 2], np.zeros(len(large))),
            "nb": (distinct[:, 3], n[head]),
            "place": (zero, pos[head]),
        }
        long = {"token", "a", "b"}
        columns = [
            pa.array(np.concatenate([u.astype(np.int64), v.astype(np.int64)]).astype(np.int64 if c in long else np.int32))
            for c, (u, v) in numbers.items()
        ]
        for values, kind in ((ids[left], np.int64), (n[left], np.int32), (pos[left], np.int32)):
            columns.append(lists(none + [values[s] for s in spans], kind))
        return pa.RecordBatch.from_arrays(columns, [*numbers, "ids", "ns", "poss"])

    def run(frames):
        held = None
        for frame in frames:
            x = {f: frame.column(f).to_numpy(zero_copy_only=False) for f in fields}
            if held is not None:
                x = {f: np.concatenate([held[f], x[f]]) for f in fields}
            if not len(x["id"]):
                continue
            last = (x["token"] == x["token"][-1]) & (x["lane"] == x["lane"][-1])
            cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            held = {f: v[cut:] for f, v in x.items()}
            if cut:
                yield work({f: v[:cut] for f, v in x.items()})
        if held is not None and len(held["id"]):
            yield work(held)

    return run


STARS = (
    "kind int, token long, lane int, lanes int, a long, b long, na int, nb int, place int, "
    "ids array<long>, ns array<int>, poss array<int>"
)


def stars(entries: DataFrame, percent: int, level: int) -> DataFrame:
    dealt = entries.repartition("token", "lane").sortWithinPartitions("token", "lane", "pos", "id")
    return dealt.mapInArrow(tidied(_stars(percent, level)), STARS)


def members(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over hashed ids: what is not in it is not among the ids."""
    place = F.pmod(F.xxhash64("id"), F.lit(BITMAP))
    words = ids.select(F.shiftright(place, 5).alias("w"), F.expr("shiftleft(1L, CAST(pmod(xxhash64(id), 32) AS INT))").alias("x"))
    out = np.zeros(BITMAP >> 5, np.uint32)
    got = words.groupBy("w").agg(F.bit_or("x").alias("x")).toPandas()
    out[got["w"].to_numpy()] = got["x"].to_numpy().astype(np.uint32)
    return out


def ids_in(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id"))


def sets_of(docs: DataFrame, ids: DataFrame, words: int, form: str) -> DataFrame:
    """(id, bits) or (id, shingles), as `form` says, of the documents with the given ids, and of few others; no text is shuffled.

    A repeated id comes once from every task at most.
    """
    wanted_ids = docs.sparkSession.sparkContext.broadcast(members(ids))
    make = {"bits": _bitmap, "shingles": lambda x: x.view(np.int64)}[form]

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            place = batch.column("place").to_numpy()
            inside = (wanted_ids.value[place >> 5] >> (place & 31).astype(np.uint32)) & 1 == 1
            keys, texts = [], []
            wanted = batch.filter(pa.array(inside))
            for key, text in zip(wanted.column("doc_id").to_pylist(), wanted.column("text").to_pylist()):
                if key not in seen:
                    seen.add(key)
                    keys.append(key)
                    texts.append(text)
            for a, b in slices(texts, SLICE):
                made = [make(x) for x in shingle_sets(texts[a:b], words)]
                yield pa.RecordBatch.from_arrays([pa.array(keys[a:b], pa.int64()), lists(made, np.int64)], ["id", form])

    key = F.col("doc_id").cast("long")
    place = F.pmod(F.xxhash64(key), F.lit(BITMAP))
    slim = docs.where("doc_id is not null").select(key.alias("doc_id"), "text", place.alias("place"))
    return slim.mapInArrow(tidied(run), f"id long, {form} array<long>")


def _bitmap(shingles: np.ndarray) -> np.ndarray:
    size = min(MOST_BITS, max(BITS, 1 << (4 * len(shingles) - 1).bit_length()))
    marks = np.zeros(size, np.uint8)
    marks[(shingles.view(np.uint64) >> np.uint64(40)) & np.uint64(size - 1)] = 1
    return np.packbits(marks).view(np.int64)


def _folded(bits, other):
    """A bitmap as one of half its length, where the other is that short."""
    n = F.size(other)
    halves = F.zip_with(F.slice(bits, 1, n), F.slice(bits, n + 1, n), lambda x, y: x.bitwiseOR(y))
    return F.when(F.size(bits) == 2 * n, halves).otherwise(bits)


def allowed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) that their bitmaps do not rule out: differing bits are at most the differing shingles.

    Sizes of pairs that can link differ by less than a factor of two, and so do their bitmaps; others are not compared.
    """
    left = sets.select(F.col("id").alias("a"), F.col("bits").alias("_x"))
    right = sets.select(F.col("id").alias("b"), F.col("bits").alias("_y"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.withColumns({"_x": _folded(F.col("_x"), F.col("_y")), "_y": _folded(F.col("_y"), F.col("_x"))})
    bits = F.aggregate(F.zip_with("_x", "_y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    apart = F.when(F.size("_x") == F.size("_y"), bits).otherwise(0)
    total = F.col("na").cast("long") + F.col("nb")
    # overlap <= (na + nb - apart) / 2, and a link needs (100 + percent) * overlap >= percent * (na + nb)
    return both.where((100 + percent) * (total - apart) >= 2 * percent * total).select("a", "b", "na", "nb").distinct()


def overlaps(pairs: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Adds `o`, the exact overlap, to stored pairs (a, b, na, nb); the shingles of their sets are made anew, no others are stored."""
    sets = keep(sets_of(docs, ids_in(pairs), words, "shingles"), "likely-sets")
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("o"))


SIDE = ("n", "pos", "id", "component", "o")


def _side(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    """One list of structs as rows (size, position, id, component, overlap with the hub), sorted; no Python object per member."""
    members = batch.column(name)
    start, end = members.offsets[row].as_py(), members.offsets[row + 1].as_py()
    fields = members.values
    x = np.column_stack([fields.field(i).slice(start, end - start).to_numpy(zero_copy_only=False) for i in range(len(SIDE))])
    return x[np.lexsort((x[:, 2], x[:, 1], x[:, 0]))]


def _crossed(a: np.ndarray, b: np.ndarray, same: bool, hub_n: int, percent: int) -> list[np.ndarray]:
    """Of a list, or of two lanes of one token: the pairs whose answer is neither known nor derivable from the hub's.

    Both sides are sorted by size and position and cut into blocks; block pairs whose bounds cannot reach the needed
    overlap, or that lie in one component, are skipped whole.
    """
    found = []
    for i in range(0, len(a), BLOCK):
        p = a[i : i + BLOCK]
        one = p[0, 3] if (p[:, 3] == p[0, 3]).all() else None
        rest_p = (p[:, 0] - p[:, 1]).max()
        for j in range(i if same else 0, len(b), BLOCK):
            q = b[j : j + BLOCK]
            if 100 * p[-1, 0] < percent * q[0, 0]:
                break  # later blocks are larger still
            if 100 * q[-1, 0] < percent * p[0, 0]:
                continue
            if min(rest_p, (q[:, 0] - q[:, 1]).max()) < needed(p[0, 0], q[0, 0], percent):
                continue
            if one is not None and (q[:, 3] == one).all():
                continue
            n, m = p[:, None, 0], q[None, :, 0]
            keep_ = (p[:, None, 3] != q[None, :, 3]) & open_pair(n, p[:, None, 1], m, q[None, :, 1], percent)
            if same and i == j:
                keep_ &= p[:, None, 2] < q[None, :, 2]
            ox, oy = p[:, None, 4], q[None, :, 4]
            known = (ox >= 0) & (oy >= 0)
            most = np.minimum(oy + n - ox, ox + m - oy)
            keep_ &= ~known | (most >= needed(n, m, percent))
            u, v = np.nonzero(keep_)
            if len(u):
                x, y = p[u], q[v]
                sure = (x[:, 4] >= 0) & (y[:, 4] >= 0) & (x[:, 4] + y[:, 4] - hub_n >= needed(x[:, 0], y[:, 0], percent))
                found.append(np.column_stack([x[:, 2], y[:, 2], x[:, 0], y[:, 0], sure]))
    return found


def _cross(percent: int):
    """The open pairs of each row's two lists, in batches of bounded size."""
    names = ["a", "b", "na", "nb", "sure"]
    kinds = [np.int64, np.int64, np.int32, np.int32, np.int32]

    def pairs(found):
        x = np.concatenate(found)
        return pa.RecordBatch.from_arrays([pa.array(x[:, i].astype(k)) for i, k in enumerate(kinds)], names)

    def run(batches):
        found, size = [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                left, right = _side(batch, "left", row), _side(batch, "right", row)
                own = _crossed(left, right, batch.column("same")[row].as_py(), batch.column("hub_n")[row].as_py(), percent)
                found += own
                size += sum(map(len, own))
                if size > PAIRS:
                    yield pairs(found)
                    found, size = [], 0
        if found:
            yield pairs(found)

    return run


def _linked(pairs: DataFrame, percent: int) -> DataFrame:
    return pairs.where(f"{100 + percent} * o >= {percent} * (CAST(na AS LONG) + nb)").select("a", "b")


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, lane: int = LANE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of (doc_id, text); the links' components are exact.

    Null, empty and wordless texts have 0 shingles and stand for themselves. Rows of one doc_id count as one vertex.
    A row without doc_id links with nothing and has a null component.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    found = keep(profiles(docs, words), "shingle-profiles")
    sketch = spark.sparkContext.broadcast(frequency_sketch(found))
    rows = found.where("chunk < 0").select("doc_id", "n", "f1", "f2")
    star = keep(stars(postings(prefixes(docs, sketch, words, percent, lane)), percent, 0), "stars")
    index = star.where("kind = 1")
    # The hubs of a token's lanes form a list of their own.
    hubs = index.where("lanes > 1").select("token", F.lit(0).alias("lane"), F.lit(1).alias("lanes"), F.col("nb").alias("n"), F.col("place").alias("pos"), F.col("b").alias("id"))
    # A set may be compared with itself through a copy of its list only; equal sets are one set already.
    pairs = star.where("kind = 0").unionByName(stars(hubs, percent, 1).where("kind = 0")).select("a", "b", "na", "nb")
    pairs = keep(pairs.distinct(), "star-pairs")
    # Most candidates fail by their bitmaps, which take a sixteenth of the shingles' room; shingles are made for the others only.
    ids = ids_in(pairs).unionByName(index.select(F.explode("ids").alias("id")))
    marks = keep(sets_of(docs, ids, words, "bits"), "candidate-bitmaps")
    likely = keep(allowed(pairs, marks, percent), "likely-pairs")
    checked = keep(overlaps(likely, docs, words), "star-overlaps")
    links = _linked(checked, percent)
    first = components(links, "set-components")

    # What the hubs leave open: lists with sets of several components.
    member = F.explode(F.arrays_zip("ns", "poss", "ids")).alias("m")
    each = index.select("token", "lane", "lanes", F.col("b").alias("hub"), F.col("nb").alias("hub_n"), member)
    each = each.select("token", "lane", "lanes", "hub", "hub_n", "m.*").withColumnRenamed("ids", "id")
    # Per set its component and its overlaps with the hubs it was compared with, at most one per shingle of its prefix.
    once = checked.groupBy("a", "b").agg(F.max("o").alias("o"))
    known = once.groupBy(F.col("a").alias("id")).agg(F.map_from_entries(F.collect_set(F.struct("b", "o"))).alias("known"))
    facts = first.join(known, "id", "full")
    each = each.join(facts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    overlap = F.when(F.col("id") == F.col("hub"), F.col("hub_n")).otherwise(F.coalesce(F.col("known")[F.col("hub")], F.lit(-1)))
    cells = [F.col(c).cast("long") for c in ("ns", "poss", "id", "component")] + [overlap.cast("long").alias("o")]
    key = ["token", "lane"]
    whole = each.groupBy(*key).agg(
        F.max("lanes").alias("lanes"),
        F.max("hub_n").alias("hub_n"),
        F.min("component").alias("lo"),
        F.max("component").alias("hi"),
        F.collect_list(F.struct(*cells)).alias("left"),
    )
    whole = keep(whole.where("lo <> hi or lanes > 1"), "open-lists")
    own = whole.where("lo <> hi").select(F.lit(True).alias("same"), "hub_n", "left", F.col("left").alias("right"))
    # Lanes of one token have hubs of their own, so overlaps do not carry over: -1 marks them unknown.
    plain = whole.where("lanes > 1").select("token", "lane", "lo", "hi", F.transform("left", lambda m: m.withField("o", F.lit(-1).cast("long"))).alias("left"))
    other = plain.select("token", *[F.col(c).alias(c + "2") for c in ("lane", "lo", "hi")], F.col("left").alias("right"))
    crossed = plain.join(other, "token").where("lane < lane2 and (lo <> hi or lo2 <> hi2 or lo <> lo2)")
    crossed = crossed.select(F.lit(False).alias("same"), F.lit(0).alias("hub_n"), "left", "right")
    # Short lists cost hardly any bytes but much time: keep them in as many tasks as there are partitions.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = own.unionByName(crossed).repartition(tasks).mapInArrow(tidied(_cross(percent)), "a long, b long, na int, nb int, sure int")
    rest = keep(rest.groupBy("a", "b", "na", "nb").agg(F.max("sure").alias("sure")), "open-pairs")
    likely = keep(allowed(rest.where("sure = 0").drop("sure"), marks, percent), "likely-pairs")
    more = _linked(overlaps(likely, docs, words), percent)
    more = more.unionByName(rest.where("sure = 1").select("a", "b"))
    final = components(first.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more), "set-components")

    classes = rows.where("n > 0 and doc_id is not null").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("id"))
    classes = classes.join(final, "id", "left").select("n", "f1", "f2", F.coalesce("component", "id").alias("component"))
    out = rows.join(classes, ["n", "f1", "f2"], "left")
    return out.select(
        "doc_id",
        F.col("n").cast("int").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )


def query(spark, folder: str) -> DataFrame:
    return join(table(spark, folder, "documents"))
