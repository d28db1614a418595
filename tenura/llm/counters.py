"""Vectors of counters of a fixed size, one per task, summed over all tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

CHUNK = 1 << 12


def chunks(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(chunk, counts) of the parts of a vector that hold anything, to leave a task as rows."""
    for at in range(0, len(counts), CHUNK):
        part = counts[at : at + CHUNK]
        if part.any():
            yield at // CHUNK, part.astype("<i8").tobytes()


def summed(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' vectors, from their rows (chunk, counts); `size` counters reach the driver, whatever the input."""

    def add(frames):
        total: dict[int, np.ndarray] = {}
        for frame in frames:
            for chunk, counts in zip(frame["chunk"].tolist(), frame["counts"]):
                own = np.frombuffer(counts, "<i8")
                total[chunk] = total[chunk] + own if chunk in total else own.copy()
        yield pd.DataFrame([(c, x.tobytes()) for c, x in total.items()], columns=["chunk", "counts"])

    out = np.zeros(size, np.int64)
    dealt = parts.select("chunk", "counts").repartition("chunk")
    for row in dealt.mapInPandas(add, "chunk int, counts binary").collect():
        part = np.frombuffer(row.counts, "<i8")
        out[row.chunk * CHUNK : row.chunk * CHUNK + len(part)] += part
    return out
