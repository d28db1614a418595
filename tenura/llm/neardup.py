"""Embedding near-duplicates by sorted projection passes.

Each pass orders the vectors of a label lexicographically by concatenated random hashes (signs of random projections),
compares every vector with a bounded window of neighbours in that order, and keeps the pairs that pass the exact
cosine test. The pairs of all passes are united to components; within a component every pair is then
verified, so that a vector's number of links does not depend on the windows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm.common import components, keep, table

THRESHOLD = 0.93
#: The share of pairs right at the threshold that the passes are to meet, the fewest passes, and how many times as crowded as evenly
#: spread vectors the order may be.
RECALL, LEAST_PASSES, CROWDING = 0.97, 4, 8
HASHES = 40
WINDOW = 256
CHUNK = 1024


def passes_for(largest: int, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes after which a pair at the threshold has met in a window with probability `recall`, in a label of so many vectors.

    Two vectors at an angle t agree in a random sign with probability 1 - t / pi. They are window neighbours where they agree in so
    many leading signs that the vectors that do are no more than the window holds, with room for uneven spread.
    """
    signs = max(0.0, math.log2(max(1.0, CROWDING * largest / window)))
    met = (1 - math.acos(min(1.0, threshold)) / math.pi) ** signs
    if met >= recall:
        return LEAST_PASSES
    return max(LEAST_PASSES, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the vectors that may link: label and id present, finite, not all zero."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("v", lambda x: x != 0)
    doubles = vectors.select("vec_id", "label", F.col("embedding").alias("v"))
    present = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    return doubles.where(present & ~bad & some)


def _unit(rows) -> np.ndarray:
    x = np.array(list(rows), np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # first, so that squares of huge or tiny values stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keys(x: np.ndarray, hashes: int, seed: int, turn: int) -> list[bytes]:
    """Signs of random projections, as bytes that sort lexicographically. The projections come from the seed alone."""
    planes = np.random.default_rng([seed, turn, x.shape[1]]).standard_normal((x.shape[1], hashes))
    return [row.tobytes() for row in np.packbits(x @ planes > 0, axis=1)]


def _grouped(groups, frames):
    """Runs of equal keys in a sorted stream, as frames; a run that spans batches is put together."""
    waiting: list[pd.DataFrame] = []
    current = None
    for frame in frames:
        for key, part in frame.groupby(groups, sort=False):
            if key != current and waiting:
                yield current, pd.concat(waiting) if len(waiting) > 1 else waiting[0]
                waiting = []
            current = key
            waiting.append(part)
    if waiting:
        yield current, pd.concat(waiting) if len(waiting) > 1 else waiting[0]


def _window_links(threshold: float, window: int):
    """Compare a sorted run block by block with the block before it; each vector meets `window` neighbours at least."""

    def run(frames):
        links_a: list[np.ndarray] = []
        links_b: list[np.ndarray] = []
        last_key, last_x, last_ids = None, None, None
        waiting = 0
        for frame in frames:
            for key, part in frame.groupby(["turn", "label", "width"], sort=False):
                x_all, ids_all = _unit(part["v"]), part["vec_id"].to_numpy()
                for at in range(0, len(ids_all), window):
                    x, ids = x_all[at : at + window], ids_all[at : at + window]
                    tail = x, ids
                    if last_key == key:
                        x, ids = np.concatenate([last_x, x]), np.concatenate([last_ids, ids])
                    near = tail[0] @ x.T >= threshold
                    i, j = np.nonzero(near)
                    a, b = tail[1][i], ids[j]
                    links_a.append(np.minimum(a, b)[a != b])
                    links_b.append(np.maximum(a, b)[a != b])
                    waiting += len(links_a[-1])
                    last_key = key
                    last_x, last_ids = x[-window:], ids[-window:]
            if waiting > 200_000:
                yield _spanning(links_a, links_b)
                links_a, links_b, waiting = [], [], 0
        if links_a:
            yield _spanning(links_a, links_b)

    return run


def _spanning(links_a, links_b) -> pd.DataFrame:
    """Of verified links, a forest that connects the same vectors."""
    parent: dict[int, int] = {}
    out = []
    a, b = np.concatenate(links_a), np.concatenate(links_b)
    for x, y in set(zip(a.tolist(), b.tolist())):
        rx, ry = x, y
        while rx in parent:
            rx = parent[rx]
        while ry in parent:
            ry = parent[ry]
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
        for start, top in ((x, min(rx, ry)), (y, min(rx, ry))):
            while start != top and start in parent:
                parent[start], start = top, parent[start]
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def link_counts(members: DataFrame, threshold: float, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links): within every component, all pairs in blocks of at most about `chunk` x `chunk` vectors.

    Links never leave a component, so this is the exact count. A large component is dealt to blocks by a hash of
    the id; nothing but counts leaves a task.
    """
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / chunk).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.col("blocks")).cast("int")
    dealt = members.join(sizes, "component").withColumn("own", own)
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(
            F.least("own", other).alias("low"), F.greatest("own", other).alias("high"), F.lit(0).alias("_")
        ),
    )
    placed = dealt.withColumn("pair", F.explode(pairs)).select(
        "component", "pair.low", "pair.high", "own", "vec_id", "copies", "v"
    )
    key = ["component", "low", "high"]
    placed = placed.repartition(*key).sortWithinPartitions(*key)

    def count(frames):
        for (_, low, high), part in _grouped(key, frames):
            x, ids, copies = _unit(part["v"]), part["vec_id"].to_numpy(), part["copies"].to_numpy()
            first = part["own"].to_numpy() == low
            if low == high:
                near = x @ x.T >= threshold
                np.fill_diagonal(near, False)
                yield pd.DataFrame({"vec_id": ids, "n": near @ copies})
            elif first.any() and not first.all():
                near = x[first] @ x[~first].T >= threshold
                yield pd.DataFrame({"vec_id": ids[first], "n": near @ copies[~first]})
                yield pd.DataFrame({"vec_id": ids[~first], "n": near.T @ copies[first]})

    parts = placed.mapInPandas(count, "vec_id long, n long")
    return parts.groupBy("vec_id").agg(F.sum("n").alias("n_links"))


def near_duplicates(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    passes: int | None = None,
    hashes: int = HASHES,
    window: int = WINDOW,
    seed: int = 7,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label).

    Equal vectors of a label are compared once and counted as often as they occur. Null, zero, non-finite and
    unlabelled vectors link with nothing and stand for themselves; so does a row without an id (component_id null,
    kept True). Vectors of different width are never compared; repeated rows and ids are rows of their own. Other columns, whatever their
    names, are not read. Without `passes` their number follows from the largest label, see `passes_for`.
    """
    fine = usable(vectors).withColumn("width", F.size("v"))
    # Equal vectors: one representative. Partial sums make a vector held by a third of the rows one row per task.
    distinct = keep(
        fine.groupBy("label", "width", "v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")),
        "vectors",
    )
    if passes is None:
        largest = distinct.groupBy("label", "width").count().agg(F.max("count")).first()[0]
        passes = passes_for(largest or 0, threshold, window)
    # All passes in one order: a vector once per pass, in the type it came in.
    turns = F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("turn")
    key = F.pandas_udf(lambda v, turn: pd.Series(_batch_keys(v, turn, hashes, seed)), "binary")
    order = ["turn", "label", "width", "key", "vec_id"]
    keyed = distinct.select(turns, "label", "width", "vec_id", "v").withColumn("key", key("v", "turn"))
    run = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    # The neighbours across a partition's edge are met in the other passes, which cut elsewhere.
    links = run.select("turn", "label", "width", "vec_id", "v").mapInPandas(_window_links(threshold, window), "a long, b long")
    grouped = components(links, "vector-components")
    members = distinct.join(grouped.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    members = members.withColumn("component", F.coalesce("component", "vec_id"))
    paired = keep(members.where("vec_id <> component").select("component").distinct(), "paired")
    counted = link_counts(members.join(paired, "component", "left_semi"), threshold)
    known = members.join(counted, "vec_id", "left").select(
        "label", "width", "v", "component", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    rows = vectors.select("vec_id", "label", F.col("embedding").alias("v"))
    rows = rows.withColumn("width", F.size("v"))
    return rows.join(known, ["label", "width", "v"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").cast("long").alias("component_id"),
        F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def _batch_keys(v: pd.Series, turn: pd.Series, hashes: int, seed: int) -> list[bytes]:
    out = [b""] * len(v)
    for (t, _), part in v.groupby([turn.to_numpy(), v.map(len).to_numpy()], sort=False):
        for place, key in zip(v.index.get_indexer(part.index), _keys(_unit(part), hashes, seed, int(t))):
            out[place] = key
    return out


def query(spark, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "embeddings"))
