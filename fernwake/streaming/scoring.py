"""New windows of a stream against a static bank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernwake.functions.arrays import to_matrix

MOST_BANK = 2_000_000  # numbers in a bank that every worker holds


def score_stream(stream: DataFrame, bank: DataFrame, k: int, dim: int) -> DataFrame:
    """The stream's rows (id, vec) with a cosine vote of their ``k`` nearest bank rows (vec, label).

    A stream has no end, so the bank has to stand on every worker; one above two million numbers is
    refused, and is better searched in batches with ``retrieval.top_k``.
    """
    rows = bank.select("vec", "label").limit(MOST_BANK // dim + 1).toArrow()
    if rows.num_rows * dim > MOST_BANK:
        raise ValueError("the bank is too large for a stream")
    b, taken = to_matrix(rows["vec"], dim)
    y = rows["label"].to_numpy()[taken].astype(float)
    b = b.astype(np.float64) / np.maximum(np.linalg.norm(b.astype(np.float64), axis=1), 1e-12)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, kept = to_matrix(batch.column(1), dim)
            m = m.astype(np.float64)
            s = (m / np.maximum(np.linalg.norm(m, axis=1), 1e-12)[:, None]) @ b.T
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            w = np.maximum(np.take_along_axis(s, top, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(kept)), pa.array((w * y[top]).sum(1) / (w.sum(1) + 1e-12), pa.float64())], ["id", "score"])

    return stream.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec")).mapInArrow(run, "id long, score double")


def window_stream(stream: DataFrame, key: str, time: str, value: str, size: str = "2 seconds", step: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Sliding features of each key as the stream runs; rows later than ``late`` are dropped by the watermark."""
    w = stream.withWatermark(time, late).groupBy(key, F.window(time, size, step).alias("w"))
    return w.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")).select(key, F.col("w.start").alias("window_start"), "n", "mean", "std")
