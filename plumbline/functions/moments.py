"""Pair statistics that stay defined on constant columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import narrow_rows


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson's r over rows where both are present; NULL when either does not vary."""
    x_kept, y_kept = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = F.sqrt(F.var_pop(x_kept)) * F.sqrt(F.var_pop(y_kept))
    return F.covar_pop(x, y) / F.when(spread > 0, spread)


@dataclass
class Gram:
    """Sums over the rows where both columns of a pair are present, as square arrays over the columns.

    Values are taken relative to each column's mean. `rows` counts the rows, `products` sums x_i x_j, `sums` and `squares` sum x_i and
    x_i squared, and `low`, `high` are the least and greatest x_i, each at [i, j] over the rows where j is present as well.
    """

    names: list[str]
    rows: np.ndarray
    products: np.ndarray
    sums: np.ndarray
    squares: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def correlation(self) -> np.ndarray:
        """Pearson's r of each pair; NaN where a side does not vary."""
        with np.errstate(invalid="ignore", divide="ignore"):
            n = np.where(self.rows > 0, self.rows, np.nan)
            own = self.squares - self.sums * self.sums / n
            r = (self.products - self.sums * self.sums.T / n) / (np.sqrt(own) * np.sqrt(own.T))
        varies = (self.low < self.high) & (self.low < self.high).T
        return np.where(varies & np.isfinite(r), np.clip(r, -1.0, 1.0), np.nan)


_PARTS = ("rows", "products", "sums", "squares")
_SCHEMA = pa.schema([("i", pa.int32()), ("j", pa.int32()), *[(p, pa.float64()) for p in (*_PARTS, "low", "high")]])


def _partial(x: np.ndarray) -> list[np.ndarray]:
    """The arrays of Gram for some rows; a missing value is NaN."""
    there = ~np.isnan(x)
    mask, filled = there.astype(np.float64), np.where(there, x, 0.0)
    low = np.where(there, x, np.inf).min(0)[:, None].repeat(x.shape[1], 1)
    high = np.where(there, x, -np.inf).max(0)[:, None].repeat(x.shape[1], 1)
    for j in np.flatnonzero(~there.all(0)):  # only columns with gaps leave out rows of the others
        both = there & there[:, [j]]
        low[:, j], high[:, j] = np.where(both, x, np.inf).min(0), np.where(both, x, -np.inf).max(0)
    return [mask.T @ mask, filled.T @ filled, filled.T @ mask, (filled * filled).T @ mask, low, high]


def gram(df: DataFrame, values: dict[str, Column]) -> Gram:
    """One scan for the means, one for all sums of all pairs: a task adds up one matrix product per batch and sends one number per
    pair and sum. The arrays that reach the driver grow with the schema alone. NaN counts as missing."""
    names, k = list(values), len(values)
    held = df.select(*[values[c].cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    held = held.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in held.columns])
    means = held.agg(*[F.avg(c).alias(c) for c in held.columns]).first()
    centred = held.select(*[(F.col(c) - F.lit(means[c])).alias(c) if means[c] is not None else F.col(c) for c in held.columns])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            # an infinite value has no place relative to a mean
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(np.float64)
            part = _partial(x)
            total = part if total is None else [a + b for a, b in zip(total[:4], part[:4])] + [
                np.minimum(total[4], part[4]), np.maximum(total[5], part[5])]
        if total is not None:
            i, j = np.divmod(np.arange(k * k), k)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                                              *[pa.array(t.ravel()) for t in total]], schema=_SCHEMA)

    summed = centred.mapInArrow(add_up, "i int, j int, " + ", ".join(f"{f.name} double" for f in list(_SCHEMA)[2:])).groupBy("i", "j").agg(
        *[F.sum(p).alias(p) for p in _PARTS], F.min("low").alias("low"), F.max("high").alias("high"))
    with narrow_rows(df.sparkSession, 8 * k):
        summed = summed.collect()
    found = {p: np.zeros((k, k)) for p in (*_PARTS, "low", "high")}
    for row in summed:
        for p, array in found.items():
            array[row["i"], row["j"]] = row[p]
    return Gram(names, **found)
