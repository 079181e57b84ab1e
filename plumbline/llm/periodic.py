"""Periodic runs of words, by an online sparse DP over diagonals.

A diagonal is a lag d: its match length at word i is one more than at word i - 1 if word i equals word i - d, else 0. A run with period q
is a stretch of matches on diagonal q that is long enough, and it is emitted where the diagonal ends.

Followed for every earlier occurrence of every word, "z z z ..." has n * n / 2 active lags. They stay sparse by scale: on scale b (1, 2,
4, ...) an occurrence counts only if the b words from it on are the same, only the nearest earlier occurrence increments its lag, and
only lags in (b / 2, b] are followed. So each word has one active lag per scale, and nothing is lost: if the b words at i also stood
less than q before, q > b / 2, then by Fine and Wilf's theorem the whole stretch had a smaller period than q. A
diagonal that matches blocks at m words in a row is a run of m + b - 1 + q words.

Blocks of twice the size are pairs of blocks. A block that stands once in a text can be no part of a repeated one, so only words at
repeated blocks go on to the next scale, which in ordinary prose are soon none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import as_bytes
from .texts import chunks

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4


def runs_of(words: np.ndarray, text: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (start, length, period) of all runs, sorted by start, then period.

    `words` are numbers of words of several texts one after the other, `text` the number of each word's text, in ascending order. A run
    has the smallest period of its words and cannot be longer on either side. At least 3 periods are needed for the scales to be exact.
    """
    if least_periods < 3:
        raise ValueError("runs of less than three periods are not found on every scale")
    n = len(words)
    sizes = np.bincount(text) if n else np.zeros(0, np.int64)
    found, block, at = [], 1, np.arange(n)
    value = text.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
    code = np.full(n, -1, np.int64)
    while len(at):
        order = np.argsort(value, kind="stable")
        place, sorted_value = at[order], value[order]
        again = np.concatenate([[False], sorted_value[1:] == sorted_value[:-1]])
        lag = np.zeros(len(at), np.int64)
        lag[order[1:]] = np.where(again[1:], place[1:] - place[:-1], 0)
        active = (2 * lag > block) & (lag <= block)
        i, d = at[active], lag[active]
        if len(i):
            begins = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1] + 1) | (d[1:] != d[:-1])]))
            matches = np.diff(np.append(begins, len(i)))  # the DP's value where a diagonal ends
            period = d[begins]
            length = matches + block - 1 + period
            long = length >= np.maximum(least_words, least_periods * period)
            found.append(np.stack([i[begins] - period, length, period], axis=1)[long])
        repeated = np.zeros(len(at), bool)
        repeated[order] = again | np.concatenate([again[1:], [False]])
        number = np.empty(len(at), np.int64)
        number[order] = np.cumsum(~again)
        # the next scale needs texts that hold a run of the smallest period it follows
        go_on = at[repeated & (sizes[text[at]] >= least_periods * (block + 1))]
        code[at[repeated]] = number[repeated]
        following = np.minimum(go_on + block, n - 1)
        paired = (go_on + block < n) & (code[following] >= 0)
        value = code[go_on[paired]] * (len(at) + 1) + code[following[paired]]
        code[at[repeated]] = -1
        at, block = go_on[paired], 2 * block
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """For each of n words, whether some run contains it after that run's first period."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(cover)[:n] > 0


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUNS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


def find_runs(docs: DataFrame, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None, doc_id: str = "doc_id",
              text: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row: all runs of a whole text as structs (start, length, period) by start, then
    period, and the words that stay, joined by one space, when of each run only the first period is kept.

    Words are maximal runs of anything but space and 0x09 to 0x0D, told apart byte by byte, numbered from 0. A null, empty or blank text
    has no words, no runs and an empty `collapsed`. Repeated rows are rows of their own, a null doc_id stays null. `rewrite` may
    replace a text's words before they are searched. Other columns are ignored; an empty table gives an empty result. One text
    is handled in one task, in memory and time that grow with its length (times its logarithm).
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(as_bytes(batch.column(1))):
                ids = batch.column(0).slice(first, len(texts))
                split = [t.split() for t in texts]
                if rewrite is not None:
                    split = [rewrite(key, words) for key, words in zip(ids.to_pylist(), split)]
                counts = np.array([len(words) for words in split])
                together = pa.array([w for words in split for w in words], pa.binary()).dictionary_encode()
                runs = runs_of(together.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(split)), counts))
                begins = np.concatenate([[0], np.cumsum(counts)])
                cuts = np.searchsorted(runs[:, 0], begins)
                kept = []
                for k, words in enumerate(split):
                    own = runs[cuts[k] : cuts[k + 1]]
                    own[:, 0] -= begins[k]
                    if len(own):
                        gone = dropped(len(words), own).tolist()
                        words = [w for w, out in zip(words, gone) if not out]
                    kept.append(b" ".join(words))
                flat = pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in range(3)], fields=list(_RUN))
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), flat),
                    pa.array(kept, pa.binary()).cast(pa.string())], schema=_RUNS)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(search, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equal ones the first by start, then period; null without runs."""
    return F.aggregate(runs, F.get(runs, 0), lambda best, run: F.when(
        run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best))
