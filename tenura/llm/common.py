"""Helpers the operators share: stored tables, global ranks, bounded samples, connected components."""

from __future__ import annotations

import ctypes

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenura.session import new_path


#: Bytes of an Arrow batch; one row at least.
BATCH_BYTES = "8m"
#: Rows that a scan decodes at once. Their whole texts make one array on the JVM's heap, which grows for it and does not shrink.
SCAN_ROWS = 512
_DEFAULTS: dict[str, str] = {}
#: Bounds of all fits. Longer texts are scored like all others, but not learned from: they would fill the driver. Of a column with
#: more classes the commonest are learned.
LONGEST_LEARNED = 200_000
CLASSES = 4096


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: the lineage ends here, and every executor sees the files."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows and bytes in a batch, scanned or sent to Python, than Spark's default, unless the user chose numbers: texts and lists can be long."""
    arrow = "spark.sql.execution.arrow"
    for name, value in (
        (f"{arrow}.maxRecordsPerBatch", str(rows)),
        (f"{arrow}.maxBytesPerBatch", BATCH_BYTES),
        ("spark.sql.parquet.columnarReaderBatchSize", str(SCAN_ROWS)),
    ):
        if name not in _DEFAULTS:
            _DEFAULTS[name] = spark.conf.get(name)
        if spark.conf.get(name) == _DEFAULTS[name]:
            spark.conf.set(name, value)


def give_back() -> None:
    """Return what a worker has freed to the system. Workers live on, and one's kept memory adds to its next task's peak."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


_KEPT: dict = {}


def kept(key, make):
    """A large thing that a Python worker makes once and keeps for its next tasks, one at a time."""
    if key not in _KEPT:
        drop_kept()
        _KEPT[key] = make()
    return _KEPT[key]


def drop_kept() -> None:
    """Give back what the worker kept for tasks of another kind."""
    if _KEPT:
        _KEPT.clear()
        give_back()


def tidied(run, keeps: bool = False):
    """A mapping function over batches that gives its memory back when its task ends; unless it `keeps` a thing, that of others goes first."""

    def whole(batches):
        if not keeps:
            drop_kept()
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def whole_ids(name: str) -> list[Column]:
    """A long key as (key, null_id) for pandas, which would turn a long column with nulls into doubles."""
    key = F.col(name).cast("long")
    return [F.coalesce(key, F.lit(0)).alias(name), key.isNull().alias("null_id")]


def lists(parts: list[np.ndarray], kind) -> "object":
    """An Arrow list column from one array per row, without a Python object per element."""
    import pyarrow as pa

    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(kind)))


def slices(texts: list, limit: int = 1_000_000):
    """Cut a batch of texts into slices (start, end) of about `limit` characters, one text at least."""
    start = size = 0
    for at, text in enumerate(texts):
        size += len(text or "")
        if size >= limit:
            yield start, at + 1
            start, size = at + 1, 0
    if start < len(texts):
        yield start, len(texts)


#: Lower-cased UTF-8 text to words: ASCII other than letters becomes a space, bytes beyond ASCII stay.
LETTERS_ONLY = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def letter_words(text: str) -> list[bytes]:
    return text.lower().encode().translate(LETTERS_ONLY).split()


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the key as text leaves the given remainder; False for a null key."""
    return F.coalesce(F.crc32(key.cast("string")) % parts == part, F.lit(False))


def ranked(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """Adds `rank`, a gapless 0-based position in the given order over the whole table, without a one-task sort.

    Rows are range-partitioned, sorted and written; a row's rank is its place in its partition plus the rows
    of the partitions before. Only the row count of each partition meets in one place. `df` is read twice
    (range bounds are sampled), so it should be a stored table.
    """
    place = F.monotonically_increasing_id()
    stored = keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place), label)
    part = F.shiftright("_place", 33)
    counts = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    starts = counts.select("_part", before.alias("_start"))  # one row per partition
    return (
        stored.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn("rank", F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_start", "_place")
    )


def class_sample(df: DataFrame, label: str, key: str, per_class: int) -> DataFrame:
    """About `per_class` rows of every class, chosen by a hash of the key, so that it repeats on every run.

    The share of each class comes from one count over all rows; no class is sorted or gathered.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).count().orderBy(F.desc("count"), label).limit(CLASSES).collect()}
    shares = {k: min(1.0, per_class / n) for k, n in counts.items() if k is not None}
    if not shares:
        return df.limit(0)
    place = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30))
    chosen = F.lit(False)
    for value, share in shares.items():
        chosen = chosen | ((F.col(label) == F.lit(value)) & (place < int(share * (1 << 30))))
    return df.where(chosen)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held: Column, per_class: int, longest: int = LONGEST_LEARNED):
    """(text, label) of about `per_class` labelled documents of each class that are not held out, as a pandas frame.

    The sample is drawn from the labels and then meets the documents as a small broadcast table, so no text is shuffled.
    Null labels and texts, and texts beyond `longest` characters, are not learned from.
    """
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held).select("doc_id", label)
    chosen = class_sample(own.where(F.col(label).isin(0, 1)), label, "doc_id", per_class)
    chosen = F.broadcast(chosen)  # about 2 * per_class rows
    fine = docs.where(F.col("text").isNotNull() & (F.length("text") <= longest)).select("doc_id", "text")
    found = fine.join(chosen, "doc_id").select("doc_id", "text", label).toPandas()
    return found.sort_values(["doc_id", "text"]).rename(columns={label: "label"}).reset_index(drop=True)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix with good avalanche (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# Connected components


def _forest(frames):
    """Of a partition's edges, those that join two trees: at most one edge per vertex leaves the task."""
    import pandas as pd

    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    for frame in frames:
        out_a, out_b = [], []
        for a, b in zip(frame["a"].tolist(), frame["b"].tolist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                out_a.append(a)
                out_b.append(b)
        yield pd.DataFrame({"a": np.array(out_a, np.int64), "b": np.array(out_b, np.int64)})


def components(edges: DataFrame, label: str = "components", rounds: int = 60) -> DataFrame:
    """(id, component): the smallest vertex reachable over the edges (a, b), for every vertex of an edge.

    Alternates large-star and small-star steps over distributed edges until nothing changes. The edges of
    each task are first thinned to a spanning forest. Every round is written to the shared folder.
    """
    spark = edges.sparkSession
    pairs = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    current = keep(pairs.mapInPandas(_forest, "a long, b long").distinct(), label)
    signature = None
    for _ in range(rounds):
        # Large star: every larger neighbour of a vertex goes to the smallest of its neighbourhood.
        both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # Small star: a vertex and its smaller neighbours go to the smallest of them.
        small_low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(small_low, "b")
        small = small.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        current = keep(small, label)
        now = current.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.countDistinct("b")).first()
        if now == signature or now[0] == 0:
            break
        signature = now
    else:
        raise RuntimeError("components did not settle")
    tree = current.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("id"), "component")
    roots = current.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return keep(tree.unionAll(roots).groupBy("id").agg(F.min("component").alias("component")), label)
