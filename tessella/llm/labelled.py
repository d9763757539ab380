"""What the two text classifiers share: a bounded labelled sample, and calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column


def held_out(id_col: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text is divisible by 5. A null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: tuple[int, int], id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, float]:
    """(id, label, text) of a bounded sample that isn't held out, and the share of label 1 among all such rows.

    In expectation at most ``per_class`` rows of class 0 and of class 1, those with the smallest hash of
    their id, with their whole texts. Rows with a null id or a label other than 0 or 1 are left
    out; of several labels for one id the largest counts, of several texts the least. Texts stay
    in the tasks: models are fitted to what tasks make of them.
    """
    own = labels.select(column(id_col).cast("long").alias("id"), column(label).cast("int").alias("label"))
    own = own.where(F.col("label").isin(0, 1) & ~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    counts = {r.label: r.n for r in own.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return docs.sparkSession.createDataFrame([], "id long, label int, text string"), 0.0
    limit = F.lit(None).cast("double")
    for k, n in counts.items():
        limit = F.when(F.col("label") == k, float(min(1.0, per_class[k] / n))).otherwise(limit)
    chosen = own.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < limit * (1 << 30))
    # the sample is bounded by its parameter, so it may be broadcast
    texts = docs.select(column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text")).where("text is not null")
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    return rows, counts.get(1, 0) / sum(counts.values())


def platt(margin: np.ndarray, label: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve that fits labels to margins, with smoothed targets."""
    n1 = int(label.sum())
    n0 = len(label) - n1
    if not n1 or not n0:
        return 1.0, 0.0
    scale = float(np.std(margin)) or 1.0
    x = margin / scale
    t = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - t) * x).sum() + 1e-3 * a, (p - t).sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
    return a / scale, b
