"""Hilbert-curve sharding, DataFrame operations only.

Metadata columns are quantised by their own quantiles, the cells are walked along a Hilbert curve, the rows are sorted
by curve index and cut into runs. Rows of a shard are close in all dimensions at once, so the column ranges of a
shard's files are narrow and a filter on any of the dimensions skips most files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.llm.common import keep, ranked

SHARDS = 24
BITS = 5


def curve_steps(n: int) -> list[int]:
    """The curve's automaton in n dimensions: entry[state << n | bits] = next state << n | rank.

    A state is the orientation of a sub-cube: the corner where the curve enters and the axis along which it leaves.
    Bits, turned into the sub-cube's frame, are the Gray code of the rank; rank and frame give the next state.
    """
    full = (1 << n) - 1

    def left(x: int, by: int) -> int:
        by %= n
        return (x << by | x >> (n - by)) & full

    def ones(x: int) -> int:
        return (x ^ (x + 1)).bit_length() - 1

    steps = []
    for state in range(n << n):
        entry, axis = state % (1 << n), state >> n
        for bits in range(1 << n):
            gray, rank = left(bits ^ entry, n - (axis + 1) % n), 0
            while gray:
                rank, gray = rank ^ gray, gray >> 1
            even = max(0, (rank - 1) // 2 * 2)
            corner = entry ^ left(even ^ even >> 1, axis + 1)
            cross = 0 if rank == 0 else ones(rank if rank % 2 else rank - 1) % n
            steps.append(((axis + cross + 1) % n << n | corner) << n | rank)
    return steps


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """The curve index of a cell, one integer below 2 ** bits per dimension: a fold over the bit planes, highest first."""
    n = len(cells)
    steps = F.array(*[F.lit(x) for x in curve_steps(n)])
    planes = F.array(
        *[
            sum((F.shiftright(cell, level).bitwiseAND(F.lit(1)) * (1 << k) for k, cell in enumerate(cells)), F.lit(0))
            for level in range(bits - 1, -1, -1)
        ]
    )
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index"))

    def walk(at: Column, plane: Column) -> Column:
        code = F.get(steps, at["state"] * (1 << n) + plane)
        return F.struct(
            F.shiftright(code, n).alias("state"), (at["index"] * (1 << n) + code % (1 << n)).alias("index")
        )

    return F.aggregate(planes, start, walk)["index"]


def _number(kind: str, value: Column, low: str | None, high: str | None) -> Column:
    """A value as a double in the same order. Text: six bytes behind the prefix that all values share."""
    if kind != "string":
        return value.cast("double")
    same = 0
    if low is not None and high is not None:
        while same < min(len(low), len(high)) and low[same] == high[same]:
            same += 1
    tail = F.rpad(F.hex(F.encode(F.substring(value, same + 1, 6), "UTF-8")), 12, "0")
    return F.conv(tail, 16, 10).cast("double")


def curve_cells(df: DataFrame, dimensions: list[str], bits: int = BITS) -> list[Column]:
    """One quantised column per dimension: equal shares of the rows, 0 for null. Two passes over these columns only."""
    kinds = dict(df.dtypes)
    ends = [f(F.col(c)) for c in dimensions for f in (F.min, F.max)]
    ends = df.agg(*[e.alias(f"e{i}") for i, e in enumerate(ends)]).first()
    numbers = [
        _number(kinds[c], F.col(c), *(ends[2 * i : 2 * i + 2] if kinds[c] == "string" else (None, None)))
        for i, c in enumerate(dimensions)
    ]
    cuts = [k / (1 << bits) for k in range(1, 1 << bits)]
    found = df.agg(*[F.percentile_approx(x, cuts, 10000).alias(f"q{i}") for i, x in enumerate(numbers)]).first()

    def place(x: Column, limits: list[float]) -> Column:
        cuts = F.array(*[F.lit(float(v)) for v in limits]).cast("array<double>")
        below = F.aggregate(cuts, F.lit(0), lambda seen, cut: seen + F.when(x >= cut, 1).otherwise(0))
        return F.when(x.isNull(), 0).otherwise(below).cast("int")

    return [place(x, sorted(set(limits or []))) for x, limits in zip(numbers, found)]


def hilbert_shards(
    rows: DataFrame, key: str, tie: str, dimensions: list[str], shards: int = SHARDS, bits: int = BITS
) -> DataFrame:
    """Adds `hilbert`, `shard` and `slot` to a slim table: runs of the curve order, counts at most one apart.

    Ties on the curve are broken by `tie`, then by `key`; equal rows take neighbouring places. Null dimensions
    fall into the first cell; an empty table stays empty. Carry no texts here: join them afterwards.
    """
    index = hilbert_index(curve_cells(rows, dimensions, bits), bits)
    placed = ranked(keep(rows.withColumn("hilbert", index), "curve"), ["hilbert", tie, key], "curve-sorted")
    total = F.lit(rows.count())
    short, longer = F.floor(total / shards), total % shards
    head = longer * (short + 1)
    rank = F.col("rank")
    shard = F.when(rank < head, F.floor(rank / (short + 1))).otherwise(
        longer + F.floor((rank - head) / F.greatest(short, F.lit(1)))
    )
    start = F.col("shard") * short + F.least(F.col("shard").cast("long"), longer)
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", (rank - start).cast("long")).drop("rank")


def document_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Documents by language, source and length: doc_id, size, text_crc32, hilbert, shard, slot.

    Size is the text's UTF-8 bytes plus 8; a null text counts as none and has the checksum 0, as an empty one.

    Equal texts with equal language and source take neighbouring places: one run of the order, cut only where a shard is full. Equal
    texts with other metadata lie where that puts them, possibly in other shards: the curve is one of metadata, not of texts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        F.col("doc_id"),
        F.octet_length(text).cast("long").alias("bytes_"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
    ).withColumn("size", F.col("bytes_") + 8)
    slim = keep(slim.drop("bytes_"), "documents-slim")
    return hilbert_shards(slim, "doc_id", "text_crc32", ["lang", "source", "size"], shards)


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write the documents below path/shard=N, in slot order. Needs unique, non-null keys."""
    full = docs.join(placed.select("doc_id", "shard", "slot"), "doc_id")
    full.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark, folder: str) -> DataFrame:
    from tenura.llm.common import table

    placed = document_shards(table(spark, folder, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "hilbert",
    )
