"""Near copies among embeddings by spherical-cap filters from structured random product codes.

A vector is rotated at random and cut into two halves; each half has a code of random directions, and a filter is a pair of
directions, one of each code. A vector belongs to all filters whose direction it exceeds a level with; they are decoded by going
through the best directions of one half only as far as the other half can still reach the level. Vectors meet where they share a
filter, and meetings are verified by the cosine in double precision.

The level is set by simulation, not by the data: random pairs at exactly the wanted cosine share a filter at this level with the
probability RECALL. More similar pairs share one more often.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.session import materialize

from .common import components, per_batch

#: Directions per half; their square is the number of filters.
CODE = 256
RECALL, SIMULATED_PAIRS = 0.98, 4_000
#: Vectors of one filter that are compared in one block of rows and one of columns.
BLOCK = 1_024
#: Rows of sorted cells that a task handles together.
HELD_ROWS = 8_192


class Filters:
    """The product code for vectors of one length."""

    def __init__(self, size: int, cosine: float):
        draw = np.random.default_rng(size)
        self.rotation = np.linalg.qr(draw.normal(size=(size, size)))[0]
        self.cut = max(1, size // 2)
        self.codes = []
        for width in (self.cut, size - self.cut):
            code = draw.normal(size=(CODE, width)) if width else np.zeros((1, 0))
            norms = np.linalg.norm(code, axis=1, keepdims=True)
            self.codes.append(code / np.where(norms > 0, norms, 1) * np.sqrt(max(width, 0) / size))
        best = []
        for _ in range(SIMULATED_PAIRS // 100):
            x = draw.normal(size=(100, size))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            y = draw.normal(size=(100, size))
            y -= (x * y).sum(1, keepdims=True) * x
            norms = np.linalg.norm(y, axis=1, keepdims=True)
            y = cosine * x + np.sqrt(1 - cosine**2) * y / np.where(norms > 0, norms, 1)
            (a, b), (c, d) = self.scores(x), self.scores(y)
            best += [np.minimum(a[i][:, None] + b[i], c[i][:, None] + d[i]).max() for i in range(100)]
        self.level = float(np.quantile(best, 1 - RECALL))

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = x @ self.rotation
        return turned[:, : self.cut] @ self.codes[0].T, turned[:, self.cut :] @ self.codes[1].T

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """The filters of each unit vector, sorted."""
        found = []
        for a, b in zip(*self.scores(x)):
            order = np.argsort(-b)
            rows = np.flatnonzero(a >= self.level - b[order[0]])
            reach = np.searchsorted(-b[order], a[rows] - self.level, side="right")  # directions of b that suffice
            at = np.repeat(rows * len(b), reach) + order[np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)]
            found.append(np.sort(at).astype(np.int32))
        return found


@lru_cache(8)
def filters(size: int, cosine: float) -> Filters:
    return Filters(size, cosine)


def _unit(packed: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length, scaled to length 1 in double precision; the largest value is scaled to 1 first, as squares of
    very large or small ones are not finite."""
    x = np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _decoded(classes: DataFrame, cosine: float, kind: str) -> DataFrame:
    schema = pa.schema([("class_id", pa.int64()), ("copies", pa.int64()), ("size", pa.int32()), ("packed", pa.binary()),
                        ("shares", pa.list_(pa.int32()))])

    def decode(columns):
        packed = [np.array(r, kind).tobytes() for r in columns["vector"].to_pylist()]
        sizes = np.array([len(p) for p in packed]) // np.dtype(kind).itemsize
        shares: list = [None] * len(packed)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            for i, found in zip(at, filters(int(size), cosine).decode(_unit([packed[i] for i in at], kind))):
                shares[i] = found
        return {"class_id": columns["class_id"], "copies": columns["copies"], "size": sizes, "packed": packed, "shares": shares}

    return classes.mapInArrow(per_batch(decode, schema), "class_id long, copies long, size int, packed binary, shares array<int>")


_CELL = ("size", "share", "low", "high")
_FOUND = pa.schema([("class_id", pa.int64()), ("links", pa.int64()), ("label", pa.int64())])


def _cell_links(x, ids, copies, block, share, low, high, cosine):
    """(row, links that this filter is the first to find, smallest id that links of this cell reach) of rows with links.

    A cell with low = high holds one block, else the rows of two blocks that meet.
    """
    if low == high:
        near = x @ x.T >= cosine
    else:
        near = np.zeros((len(x), len(x)), bool)
        at, cols = np.flatnonzero(block == low), np.flatnonzero(block == high)
        near[np.ix_(at, cols)] = x[at] @ x[cols].T >= cosine
        near |= near.T
    np.fill_diagonal(near, False)
    rows = np.flatnonzero(near.any(1))
    if not len(rows):
        return rows, rows, rows
    near = near[np.ix_(rows, rows)]
    # a link is counted by the smallest filter that both ends have
    lower = [s[s < share] for s in filters(x.shape[1], cosine).decode(x[rows])]
    names, place = np.unique(np.concatenate(lower), return_inverse=True)
    member = np.zeros((len(rows), max(1, len(names))), np.float32)
    member[np.repeat(np.arange(len(rows)), [len(s) for s in lower]), place] = 1
    links = (near & (member @ member.T == 0)) @ copies[rows]
    label = ids[rows]
    while True:
        new = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(1))
        if np.array_equal(new, label):
            return rows, links, label
        label = new


def _compared(cells: DataFrame, cosine: float, kind: str) -> DataFrame:
    """(class_id, links, label) from cells, a partition holding whole cells in order."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        key = np.stack([table[c].to_numpy() for c in _CELL], 1)
        ids, copies, block = (table[c].to_numpy() for c in ("class_id", "copies", "block"))
        packed = table["packed"].to_pylist()
        begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
        out = [[], [], []]
        x, size = None, None
        for a, b in zip(begin, np.append(begin[1:], len(key))):
            if key[a, 0] != size:  # vectors of one length follow each other
                size, base = key[a, 0], a
                x = _unit(packed[a : a + int((key[a:, 0] == size).sum())], kind)
            rows, links, label = _cell_links(
                x[a - base : b - base], ids[a:b], copies[a:b], block[a:b], *(int(v) for v in key[a, 1:]), cosine)
            if len(rows):
                for to, found in zip(out, (ids[a:b][rows], links, label)):
                    to.append(found)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else [], pa.int64()) for v in out], schema=_FOUND)

    def run(batches):
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.num_rows >= HELD_ROWS:
                last = np.stack([held[c].to_numpy() for c in _CELL], 1)
                cut = int(np.flatnonzero((last != last[-1]).any(1)).max(initial=-1)) + 1
                if cut:
                    yield solve(held.slice(0, cut).combine_chunks())
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield solve(held.combine_chunks())

    return cells.repartition(*_CELL).sortWithinPartitions(*_CELL).mapInArrow(run, "class_id long, links long, label long")


def link_vectors(embeddings: DataFrame, cosine: float = 0.9, block_rows: int = BLOCK, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id) per row: other vectors with at least the cosine, and the smallest id that links reach.

    Equal vectors are compared once and count as often as they occur. A vector that is null, empty, zero or holds null or
    non-finite values links with nothing, and vectors of different lengths never do; its component is its own id. Rows that
    repeat an id stay rows. Other columns are ignored; an empty table gives an empty result.
    """
    element = dict(embeddings.dtypes)[vector]
    kind = "<f4" if element == "array<float>" else "<f8"
    # adding zero makes -0.0 and 0.0 one value
    value = F.transform(F.col(vector), lambda v: v.cast("double") + F.lit(0.0))
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), value.alias("vector"))
    fine = F.coalesce(F.size("vector") > 0, F.lit(False)) & F.coalesce(F.forall(
        "vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.coalesce(
        F.exists("vector", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("vector", F.when(fine, F.col("vector")))
    classes = rows.where("vector IS NOT NULL").groupBy("vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    classes = materialize(classes.withColumn("class_id", F.monotonically_increasing_id()), "caps-classes")
    decoded = materialize(_decoded(classes.select("class_id", "copies", "vector"), cosine, kind), "caps-decoded")

    members = decoded.select("class_id", "copies", "packed", "size", F.explode("shares").alias("share"))
    loads = decoded.select("size", F.explode("shares").alias("share")).groupBy("size", "share").agg(
        F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"), F.count("*").alias("load")).where("load > 1").drop("load")
    members = members.join(loads, ["size", "share"]).withColumn("block", F.pmod(F.xxhash64("class_id"), "blocks").cast("int"))
    # block i meets every block j, itself included, once
    cells = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "class_id", "copies", "packed", "size", "share", "block",
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    found = materialize(_compared(cells, cosine, kind), "caps-found")
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("class_id").alias("a"), F.col("label").alias("b")), "caps")
    named = classes.join(links, "class_id", "left").join(roots.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "vector", "copies", "first", "links", F.coalesce("root", "class_id").alias("root"))
    names = named.groupBy("root").agg(F.min("first").alias("component"))
    named = named.join(names, "root").select("vector", "copies", "links", "component")
    return rows.join(named, "vector", "left").select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"))
