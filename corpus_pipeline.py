"""The corpus pipeline: language identification, toxicity, near-duplicate join, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes and reads again before the next. All
but the last return the columns of the documents table. Null and empty texts: language identification rejects what
has no letter, so they end there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.llm import jaccard, langid, packing, toxicity
from tenura.llm.common import bounded_batches, held_out, keep, table

#: A document is rejected when its toxicity reaches this.
MOST_TOXIC = 0.5
#: Words of 64 rows that are sent to every executor to tell which rows stay: those of 33 million rows, two longs each.
MARKS = 1 << 19


def free_name(docs: DataFrame) -> str:
    """A column name that the table does not have."""
    name = "found_"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. Those without text or letters go, and those that are like no learned document.

    A score is a mean over words, so it must reach the lowest that a training document had, less the standard error that a mean of so
    few words can have. Code, noise and languages that were not learned score far lower. The network learns from the documents outside the held-out third, as in op3. If no document has a language to
    learn from, nothing can be told and only texts without a letter go.
    """
    bounded_batches(spark)
    network = langid.train_network(docs.where(~held_out(F.col("doc_id"), 3, 1)))
    if network is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    name = free_name(docs)
    found = docs.withColumn(name, langid.language_column(network, F.col("text")))
    least = F.lit(network.least) - 0.5 / F.sqrt(f"{name}.words")
    told = (F.col(f"{name}.lang_pred") != langid.UNKNOWN) & (F.col(f"{name}.score") >= least)
    return found.where(told).drop(name)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below `MOST_TOXIC`. The model learns from labelled documents outside the held-out fifth, as in op2."""
    bounded_batches(spark)
    held = held_out(F.col("doc_id"), 5, 0)
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"), held)
    name = free_name(docs)
    found = docs.withColumn(name, toxicity.toxicity_column(model, F.col("text")))
    return found.where(F.col(f"{name}.score") < MOST_TOXIC).drop(name)


def at_places(placed: DataFrame, place: str, kept: DataFrame) -> DataFrame:
    """The rows whose `place` is in `kept`. Whole rows are wide, so they stay where they are scanned: a bit for each place goes to them.

    64 places, which a scan numbers in a row, make one word. Up to `MARKS` words go to every executor; a larger table meets them by a
    shuffle of its rows.
    """
    word = free_name(placed)
    rows = placed.withColumn(word, F.shiftright(place, 6))
    bits = free_name(rows)
    bit = F.bit_or(F.expr(f"shiftleft(1L, CAST({place} & 63 AS INT))"))
    marks = keep(kept.groupBy(F.shiftright(place, 6).alias(word)).agg(bit.alias(bits)), "kept-rows")
    few = marks.count() <= MARKS
    return rows.join(F.broadcast(marks) if few else marks, word).where(f"shiftright({bits}, CAST({place} & 63 AS INT)) & 1 = 1")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, Jaccard 0.8 or more): the smallest doc_id.

    Rows are compared as rows, by their place in the stored table, so repeated ids with different texts all stay, of repeated rows one
    does, and rows without a doc_id are compared like all others; they stay where their group has no row with an id.
    """
    place, group = free_name(docs), free_name(docs) + "g"
    placed = docs.withColumn(place, F.monotonically_increasing_id())
    found = jaccard.join(placed.select(F.col(place).alias("doc_id"), "text"), words=5, percent=80)
    found = found.select(F.col("doc_id").alias(place), F.col("component_id").alias(group))
    ids = placed.select(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), place)
    first = F.min(F.struct("no_id", "id", place)).getField(place).alias(place)
    kept = ids.join(found, place).groupBy(group).agg(first).select(place)
    return at_places(placed, place, kept).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents with their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("toxicity", clean),
    ("near_duplicates", distinct),
    ("packing", pack),
]
#: SQL can express neither the trained models nor the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
