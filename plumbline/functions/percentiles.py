"""Exact order statistics of any number of columns by radix selection.

Values are compared as 64-bit whole numbers that keep their order: whole numbers as they are, times in microseconds, doubles by the bits
of their floating-point form. A pass counts, for every range that still holds a wanted rank, how many values have which leading 16 bits
within the range: one scan for all columns of a table, at most 65,537 counters a range and task. Each pass shortens a range by 16 bits,
so four passes end at single values whatever the values are, and nothing ever holds the values of a column. A range of few values
is counted value by value at once, and counters tell between which ends their values lie, so a range that holds one value many
times is at its end as well: the search usually takes two passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import as_double, base_type, epoch_micros, quoted
from plumbline.session import narrow_rows

#: Bits settled per pass.
DIGIT_BITS = 16
#: Values of a range that are counted one by one.
FEW_VALUES = 1 << 16


def double_keys(values: np.ndarray) -> np.ndarray:
    """The bits of doubles as whole numbers in the order of the values; both zeros are 0."""
    bits = np.abs(values).view(np.int64)
    return np.where(values < 0, -bits, bits)


def key_double(key: int) -> float:
    """The double of a key."""
    value = float(np.array([abs(key)], np.int64).view(np.float64)[0])
    return -value if key < 0 else value


def ordered(df: DataFrame, name: str) -> Column:
    """A column as a double or a bigint in the order of its values."""
    kind = base_type(df.schema[name].dataType)
    if kind == "datetime":
        return epoch_micros(quoted(name))
    if kind == "float":
        return as_double(df, name)
    return quoted(name).cast("int").cast("bigint") if kind == "bool" else quoted(name).cast("bigint")


@dataclass
class Span:
    """The ends and the number of a column's values."""

    low: float | int | None
    high: float | int | None
    count: int


@dataclass
class _Range:
    """Keys from low to high: `inside` values, `below` smaller ones, and the ranks wanted among them."""

    column: int
    low: int
    high: int
    below: int
    inside: int
    ranks: list[int] = field(default_factory=list)
    shift: int = 0
    dense: bool = False

    def __post_init__(self) -> None:
        """How many low bits a pass leaves out, and whether its counters stand in an array or by value."""
        if self.inside > FEW_VALUES:
            self.shift = max(0, (self.high - self.low).bit_length() - DIGIT_BITS)
        self.dense = self.shift > 0 or self.high - self.low < FEW_VALUES


def values_at_ranks(df: DataFrame, values: dict[str, Column], ranks: dict[str, list[int]],
                    spans: dict[str, Span]) -> dict[str, dict[int, float | int]]:
    """The value at each wanted rank (from 0) of each column of doubles or whole numbers, missing ones left out.

    `spans` are known from an earlier scan.
    """
    names = [n for n in values if ranks[n]]
    if not names:
        return {n: {} for n in values}
    held = df.select(*[values[n].alias(f"x{i}") for i, n in enumerate(names)])
    is_double = [f.dataType.typeName() == "double" for f in held.schema]

    def key(value, i: int) -> int:
        return int(double_keys(np.array([value], np.float64))[0]) if is_double[i] else int(value)

    found: list[dict[int, int]] = [{} for _ in names]
    ranges = [_Range(i, key(spans[n].low, i), key(spans[n].high, i), 0, spans[n].count, sorted(set(ranks[n])))
              for i, n in enumerate(names)]
    while True:
        for r in ranges:
            if r.low == r.high:
                found[r.column].update({rank: r.low for rank in r.ranks})
        ranges = [r for r in ranges if r.low < r.high]
        if not ranges:
            break
        with narrow_rows(held.sparkSession, 8 * len(names)):
            ranges = _pass(held, is_double, ranges)
    result = {n: {} for n in values}
    for i, n in enumerate(names):
        result[n] = {rank: key_double(k) if is_double[i] else k for rank, k in found[i].items()}
    return result


_COUNTS = pa.schema([("range", pa.int32()), ("digit", pa.int64()), ("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])

#: Cells of the table that tells whether a value may be in any of a column's ranges.
_CELLS = 1 << 16


@dataclass
class _Members:
    """The ranges of one column in their order, and by which values it is seen at once that none holds them."""

    numbers: list[int]
    low: np.ndarray
    high: np.ndarray
    shift: int
    cells: np.ndarray

    @classmethod
    def of(cls, numbers: list[int], ranges: list[_Range]) -> _Members:
        low, high = [ranges[n].low for n in numbers], [ranges[n].high for n in numbers]
        shift = max(0, (high[-1] - low[0] + 1).bit_length() - _CELLS.bit_length() + 1)
        cells = np.zeros((high[-1] - low[0] >> shift) + 1, bool)
        for first, last in zip(low, high):
            cells[first - low[0] >> shift:(last - low[0] >> shift) + 1] = True
        return cls(numbers, np.array(low, np.int64), np.array(high, np.int64), shift, cells)

    def split(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(range, keys within it)."""
        x = _where(x, (x >= self.low[0]) & (x <= self.high[-1]))
        if len(self.numbers) == 1:
            yield self.numbers[0], x
            return
        # a difference of keys can be too wide for a signed number
        x = _where(x, self.cells[(x - self.low[0]).view(np.uint64) >> np.uint64(self.shift)])
        of = np.searchsorted(self.low, x, side="right") - 1
        held = x <= self.high[of]
        x, of = _where(x, held), _where(of, held)
        order = np.argsort(of.astype(np.min_scalar_type(len(self.numbers))), kind="stable")
        ends = np.cumsum(np.bincount(of, minlength=len(self.numbers)))
        for n, part in zip(self.numbers, np.split(x[order], ends[:-1])):
            if len(part):
                yield n, part


def _where(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    return x if held.all() else x[held]


class _Tally:
    """Counts of the digits of one range, and its least and greatest key. Keys are gathered until there are about as many as
    counters, which are then passed over once."""

    def __init__(self, of: _Range) -> None:
        self.shift, self.dense, self.first = of.shift, of.dense, of.low >> of.shift
        room = (of.high >> of.shift) - self.first + 1
        self.total = np.zeros(room, np.int64) if of.dense else {}
        self.limit = room if of.dense else FEW_VALUES
        self.waiting: list[np.ndarray] = []
        self.size, self.low, self.high = 0, of.high, of.low

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(keys)
        self.size += len(keys)
        if self.size >= self.limit:
            self.settle()

    def settle(self) -> None:
        if not self.size:
            return
        keys = np.concatenate(self.waiting)
        self.waiting, self.size = [], 0
        self.low, self.high = min(self.low, int(keys.min())), max(self.high, int(keys.max()))
        digit = keys >> self.shift
        if self.dense:
            self.total += np.bincount(digit - self.first, minlength=len(self.total))
        else:
            for value, times in zip(*(a.tolist() for a in np.unique(digit, return_counts=True))):
                self.total[value] = self.total.get(value, 0) + times

    def rows(self, n: int) -> pa.RecordBatch:
        """A row per digit; all tell the ends of the range, since no digit has its own."""
        self.settle()
        if self.dense:
            at = np.flatnonzero(self.total)
            digit, count = at + self.first, self.total[at]
        else:
            digit, count = np.array(list(self.total), np.int64), np.array(list(self.total.values()), np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(digit), n, np.int32)), pa.array(digit.astype(np.int64)), pa.array(count),
             *[pa.array(np.full(len(digit), end, np.int64)) for end in (self.low, self.high)]], schema=_COUNTS)


def _pass(held: DataFrame, is_double: list[bool], ranges: list[_Range]) -> list[_Range]:
    """Each range cut into the sub-ranges that hold its ranks."""
    by_column: dict[int, list[int]] = {}
    for n, r in enumerate(ranges):
        by_column.setdefault(r.column, []).append(n)
    for members in by_column.values():
        members.sort(key=lambda n: ranges[n].low)
    columns = sorted(by_column)
    members_of = {c: _Members.of(members, ranges) for c, members in by_column.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[int, _Tally] = {}
        for batch in batches:
            for place, c in enumerate(columns):
                x = batch.column(place).drop_null().to_numpy(zero_copy_only=False)
                for n, keys in members_of[c].split(double_keys(x) if is_double[c] else x):
                    if n not in tallies:
                        tallies[n] = _Tally(ranges[n])
                    tallies[n].add(keys)
        for n, tally in tallies.items():
            yield tally.rows(n)

    counted = held.select(*[f"x{c}" for c in columns]).mapInArrow(
        count, "range int, digit long, n long, low long, high long").groupBy("range", "digit").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    upto = counted.withColumn("upto", F.sum("n").over(
        Window.partitionBy("range").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)))
    wanted = held.sparkSession.createDataFrame(
        [(n, rank - r.below) for n, r in enumerate(ranges) for rank in r.ranks], "range int, rank long")
    # one row per wanted rank reaches the driver
    hits = upto.join(F.broadcast(wanted), "range").where("rank < upto AND rank >= upto - n").collect()
    cut: dict[tuple[int, int], _Range] = {}
    for h in hits:
        whole, before, digit = ranges[h["range"]], int(h["upto"]) - int(h["n"]), int(h["digit"])
        part = cut.setdefault((h["range"], digit), _Range(
            whole.column, max(int(h["low"]), digit << whole.shift), min(int(h["high"]), ((digit + 1) << whole.shift) - 1),
            whole.below + before, int(h["n"])))
        part.ranks.append(int(h["rank"]) + whole.below)
    return list(cut.values())


def ranks_of(shares: list[float], count: int) -> list[int]:
    """The ranks on either side of each percentile's position."""
    positions = [share * (count - 1) for share in shares] if count else []
    return sorted({r for p in positions for r in (math.floor(p), math.ceil(p))})


def interpolated(share: float, count: int, value_at: dict[int, float]) -> float | None:
    """The percentile by linear interpolation between the values at two ranks."""
    if not count:
        return None
    position = share * (count - 1)
    low, high = math.floor(position), math.ceil(position)
    if low == high or value_at[low] == value_at[high]:
        return float(value_at[low])
    return (high - position) * value_at[low] + (position - low) * value_at[high]
