"""Exact top-k search by inner product: columnar branch and bound.

Blocks of vectors are held dimension by dimension (vertical layout). Scores are accumulated one
block of dimensions at a time; what the dimensions not yet read can still add is bounded by the product of the remaining
masses (Cauchy-Schwarz), and candidates that cannot reach a query's k-th best score any more are compacted away.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenura.llm.common import keep, ranked, table

K = 5
QUERY_BLOCK = 1024
#: Queries that are searched for in one pass over the rows.
ROUND = 1 << 15
ROW_BLOCK = 4096
DIM_BLOCK = 16
SCALE = 256


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): components as floor(scale * x). Vectors that are null, empty or hold null or non-finite values go."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    doubles = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    fine = doubles.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)
    return fine.select("vec_id", F.transform("v", lambda x: F.floor(x * float(scale)).cast("long")).alias("v"))


class _Best:
    """The k best (score, id) of every query so far; ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = [np.empty(0, np.int64)] * n
        self.ids = [np.empty(0, np.int64)] * n

    def floor(self, q: int):
        return self.score[q][self.k - 1] if len(self.score[q]) >= self.k else None

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score[q], score]), np.concatenate([self.ids[q], ids])
        top = np.lexsort((ids, -score))[: self.k]
        self.score[q], self.ids[q] = score[top], ids[top]


def search_block(query_ids, queries, ids, columns, best: _Best, dim_block: int = DIM_BLOCK) -> int:
    """Search one block of rows for one block of queries (both dimension-major); returns the products computed.

    Partial sums are integers below 2 ** 52 and exact as doubles; where they could exceed that, 64-bit integers
    are used. The bounds are rounded up, so rounding never drops a candidate.
    """
    width, n = columns.shape
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(columns).max(initial=0)) * width
    kind = np.float64 if largest < 2.0**52 else np.int64
    left, right = queries.astype(kind), columns.astype(kind)
    cuts = list(range(0, width, dim_block)) + [width]

    def masses(x):
        squares = np.cumsum(x[::-1].astype(np.float64) ** 2, axis=0)[::-1]
        return [np.sqrt(squares[c]) * (1 + 1e-9) if c < width else np.zeros(x.shape[1]) for c in cuts]

    left_mass, right_mass = masses(left), masses(right)
    first = left[: cuts[1]].T @ right[: cuts[1]]
    work = first.size * cuts[1]
    for q in range(len(query_ids)):
        alive = np.flatnonzero(ids != query_ids[q])
        partial = first[q][alive]
        if len(alive) > 4 * best.k and len(cuts) > 2:  # raise the floor with the likeliest few first
            lead = np.argpartition(-partial, best.k)[: best.k]
            rows = alive[lead]
            best.add(q, (left[:, q] @ right[:, rows]).astype(np.int64), ids[rows])
            rest = np.ones(len(alive), bool)
            rest[lead] = False
            alive, partial = alive[rest], partial[rest]
        for c in range(1, len(cuts)):
            floor = best.floor(q)
            if floor is not None:
                bound = np.ceil(partial.astype(np.float64) + left_mass[c][q] * right_mass[c][alive])
                stay = bound * (1 + 1e-12 * np.sign(bound)) >= floor
                alive, partial = alive[stay], partial[stay]
            if not len(alive) or c == len(cuts) - 1:
                break
            part = slice(cuts[c], cuts[c + 1])
            partial = partial + left[part, q] @ right[part][:, alive]
            work += len(alive) * (cuts[c + 1] - cuts[c])
        if len(alive):
            best.add(q, partial.astype(np.int64), ids[alive])
    return work


def query_blocks(queries: pd.DataFrame, query_block: int = QUERY_BLOCK) -> list[tuple]:
    """(ids, places, columns) of blocks of numbered queries of one width each, dimension by dimension."""
    out = []
    for _, part in queries.groupby(queries["v"].map(len), sort=True):
        for at in range(0, len(part), query_block):
            own = part.iloc[at : at + query_block]
            columns = np.ascontiguousarray(np.array(own["v"].tolist(), np.int64).T)
            out.append((own["vec_id"].to_numpy(), own["rank"].to_numpy(), columns))
    return out


def search_rows(frames, blocks: list[tuple], k: int, row_block: int):
    """The k best of every query over the rows of one task.

    A query is named by its place, the same in every task: its id may repeat.
    """
    best = [_Best(len(ids), k) for ids, _, _ in blocks]
    waiting: dict[int, tuple[list, list]] = {}

    def search(width):
        ids, vectors = waiting.pop(width)
        ids, columns = np.array(ids), np.ascontiguousarray(np.array(vectors, np.int64).T)
        for (query_ids, _, query_columns), own in zip(blocks, best):
            if len(query_columns) == width:
                search_block(query_ids, query_columns, ids, columns, own)

    for frame in frames:
        for vec_id, v in zip(frame["vec_id"].tolist(), frame["v"]):
            ids, vectors = waiting.setdefault(len(v), ([], []))
            ids.append(vec_id)
            vectors.append(v)
            if len(ids) == row_block:
                search(len(v))
    for width in list(waiting):
        search(width)
    for (query_ids, places, _), found in zip(blocks, best):
        n = [len(x) for x in found.score]
        columns = {"place": np.repeat(places, n), "query_id": np.repeat(query_ids, n)}
        yield pd.DataFrame(columns | {"vec_id": np.concatenate(found.ids), "score": np.concatenate(found.score)}).astype("int64")


def top_k(
    queries: DataFrame, rows: DataFrame, k: int = K, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK, round_: int = ROUND
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query its k rows of highest integer inner product.

    Both sides come from `quantised`. A query meets all rows of its width but those with its own id; fewer than k rows
    give fewer results; an empty side gives none. Repeated rows count as rows of their own, and ties go to the smaller id. Rows
    without an id take no part. Components beyond 2 ** 63 / `SCALE` saturate, and sums of products wrap around beyond 64 bits, as
    longs do. Columns of other names are not read.

    Queries are numbered and taken in rounds of a fixed number, sent to every executor as blocks. Rows stay where they are
    scanned: a task holds the blocks, one block of rows and k results per query, and only those results are shuffled.
    """
    spark = rows.sparkSession
    numbered = ranked(keep(queries, "queries"), ["vec_id"], "queries-sorted")
    total = numbered.count()
    shape = "place long, query_id long, vec_id long, score long"
    order = Window.partitionBy("place").orderBy(F.desc("score"), "vec_id")
    found = None
    for first in range(0, max(total, 1), round_):
        own = numbered.where(F.col("rank").between(first, first + round_ - 1)).select("vec_id", "v", "rank")
        blocks = spark.sparkContext.broadcast(query_blocks(own.toPandas(), query_block))  # `round_` vectors at most

        def search(frames, blocks=blocks):
            return search_rows(frames, blocks.value, k, row_block)

        best = rows.select("vec_id", "v").mapInPandas(search, shape).withColumn("rank", F.row_number().over(order))
        best = best.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        best = keep(best, "best")
        blocks.unpersist()
        found = best if found is None else found.unionAll(best)
    return found


def query(spark, folder: str) -> DataFrame:
    vectors = quantised(table(spark, folder, "embeddings"))
    return top_k(vectors.where("vec_id % 50 = 0"), vectors)


SQL = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id,
         CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(r.v AS DOUBLE[])) AS BIGINT) AS score
  FROM fine q JOIN fine r ON q.vec_id <> r.vec_id AND len(q.v) = len(r.v)
  WHERE q.vec_id % 50 = 0
), placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 5
"""
