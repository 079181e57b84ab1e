"""Bounded samples of labelled documents, and small linear models fitted on them with numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Texts longer than this are not used to fit a classifier (they are scored whole).
FIT_BYTES = 40_000
#: Labels that are learned at most, and rows that a label needs where there are more.
MAX_LABELS, RARE = 64, 5


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id's text modulo `by`; null for a null id."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % by


def bounded_sample(rows: DataFrame, label: str, per_label: int, docs: DataFrame | None = None) -> list[tuple[object, str]]:
    """(label, text) of `per_label` different texts for each label, all where there are fewer, sorted, the same on each run.

    `rows` has doc_id and the label, and the text unless it is in `docs`. Texts are drawn by their own hash and cut off at a rank, so
    neither repeated ids nor repeated texts change how many leave Spark. Rows without label or text, and texts over FIT_BYTES, are
    left out. At most MAX_LABELS labels are learned: beyond, labels of fewer than RARE rows are left out, and if more are left,
    that is an error.
    """
    rows = rows.where(F.col(label).isNotNull())
    most = rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(MAX_LABELS + 1).collect()
    if len(most) > MAX_LABELS:
        if most[-1]["count"] >= RARE:
            raise ValueError(f"more than {MAX_LABELS} values of {label} have {RARE} rows or more: they cannot be told apart pair by pair")
        most = [r for r in most if r["count"] >= RARE]
    share = {r[label]: min(1.0, 4 * per_label / r["count"]) for r in most}
    if not share:
        return []
    texts = (rows if docs is None else docs).where(F.col("text").isNotNull() & (F.octet_length("text") <= FIT_BYTES))
    texts = texts.withColumn("of", F.xxhash64("text")).withColumn("draw", F.pmod(F.xxhash64(F.lit(29), "of"), F.lit(1 << 40)))
    found: dict[object, list[str]] = {}
    while share:
        least = F.lit(0).cast("long")
        for value, part in share.items():
            least = F.when(F.col(label) == F.lit(value), F.lit(int(part * (1 << 40)))).otherwise(least)
        # ids and hashes are joined and ranked; only the chosen texts are fetched, at most per_label a label
        drawn = texts.where(F.col("draw") < int(max(share.values()) * (1 << 40))).select(
            "doc_id", "of", "draw", *([label] if docs is None else []))
        if docs is not None:
            drawn = drawn.join(rows.select("doc_id", label).distinct(), "doc_id")
        drawn = drawn.where(F.col("draw") < least).select(label, "draw", "of").distinct()
        # a few times per_label texts of a label
        chosen = drawn.withColumn("rank", F.row_number().over(Window.partitionBy(label).orderBy("draw", "of"))).where(
            F.col("rank") <= per_label).select(F.col(label).alias("chosen"), F.col("of").alias("wanted"))
        ranked = texts.join(F.broadcast(chosen), F.col("of") == F.col("wanted")).groupBy("chosen", "of").agg(
            F.min("text").alias("text")).collect()
        here: dict[object, list[str]] = {value: [] for value in share}
        for r in ranked:
            here[r["chosen"]].append(r["text"])
        found.update(here)
        # where many rows are copies, few texts are drawn: those labels are drawn again from more
        share = {value: min(1.0, 64 * part) for value, part in share.items() if part < 1 and len(here[value]) < per_label}
    return sorted(((value, text) for value, own in found.items() for text in own), key=lambda x: (str(x[0]), x[1]))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Weights (the last is the constant) of a ridge logistic regression, by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) / len(y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hessian, gradient)
    return w


def linear_svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Weights (the last is the constant) of a linear machine with squared hinge loss; y is -1 or 1, classes weigh alike."""
    x = np.c_[x, np.ones(len(x), x.dtype)]
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    step = 1 / (2 * float((x * x).sum(1).max()) + ridge)
    w = ahead = np.zeros(x.shape[1], x.dtype)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead)).astype(x.dtype)
        new = ahead - step * (ridge * ahead - 2 * x.T @ (share * y * slack))
        ahead, w = new + np.float32(k / (k + 3)) * (new - w), new
    return w.astype(np.float32)
