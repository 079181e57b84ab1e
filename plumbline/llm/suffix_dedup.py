"""Bytes covered by a string of SPAN bytes that also starts elsewhere, by a sparse suffix sort with hashed comparisons.

Only some suffixes need sorting. Of the GRAM-byte strings inside any SPAN bytes the one with the smallest hash is the anchor (the
last on ties), so equal SPAN bytes have equal anchors at equal places, and one anchor stands for about 70 windows. What
matters about an anchor is its context: the bytes that a window with this anchor can cover.

1. Anchors are counted by (hash of the anchor's string, cryptographic digest of the context). A context that occurs twice is removed
   whole; such groups are summed on the map side, so thousands of copies are one row per task. Most repeated bytes (all exact
   copies, the inside of long repeated passages) are settled here; the sort settles where repetitions begin and end.
2. A context that occurs once is compared with the other contexts of its anchor string. The suffixes that begin at the anchors,
   and the reversed prefixes that end there, are sorted by mergesort; two of them are compared by a binary search over prefix
   polynomial hashes (modulo two primes, to drawn bases) for their common extension, then by the next byte. The order of neighbours
   and their common extensions are verified byte by byte, and a collision repeats the sort with other bases. Contexts that share d bytes before the
   anchor and SPAN - d from it are runs in both orders, so a window is repeated if its pair of runs occurs twice.
3. Anchor strings with very many different contexts are not sorted in one task: their windows are counted as rows.

Texts are joined with positions only where something of them is open or removed.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.session import materialize

from .common import per_batch, small_batches
from .texts import mix

SPAN, GRAM = 200, 40
LEFT = SPAN - GRAM
#: Texts are hashed in pieces of so many window starts.
PIECE = 1 << 20
#: Contexts sorted together, and contexts of one anchor string beyond which windows are counted as rows.
SORTED_ROWS, HOT_CONTEXTS = 8_192, 50_000
#: Up to so many documents are picked by a broadcast of their ids; beyond, the join shuffles texts.
BROADCAST_ROWS = 500_000
#: Base of the rolling hash that picks anchors; what it cannot tell apart only meets more often, and is compared by its bytes.
BASE = 0x9E3779B97F4A7C15
#: Prime moduli of the prefix hashes of a sort; their bases are drawn anew for each sort.
MODULI = (2**31 - 1, 2**31 - 19)
DRAWS = 8

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64."""
    if base not in _tables or len(_tables[base][0]) < n:
        size = max(n, 1 << 17)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, np.uint64(b))
            p[0] = 1
            made.append(np.cumprod(p))
        _tables[base] = tuple(made)
    return _tables[base]


def _last_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Places of the smallest value (the last of equal ones) of each run of `width` values."""
    place = np.uint64(0xFFFFFF) - np.arange(len(values), dtype=np.uint64)
    low = (values & ~np.uint64(0xFFFFFF)) | place
    size = 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    low = low[np.concatenate([[True], low[1:] != low[:-1]])]
    return (np.uint64(0xFFFFFF) - (low & np.uint64(0xFFFFFF))).astype(np.int64)


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(places, hashes of their GRAM bytes, digests of their contexts) of a text's anchors."""
    places, grams = [], []
    for begin in range(0, len(text) - SPAN + 1, PIECE):
        low, high = max(0, begin - SPAN), min(len(text), begin + PIECE + 3 * SPAN)
        codes = np.frombuffer(text, np.uint8, high - low, low).astype(np.uint64) + np.uint64(1)
        power, back = _powers(BASE, len(codes) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * power[: len(codes)])])
        last = min(len(text) - SPAN, begin + PIECE - 1)  # the last window start of this piece
        first, end = begin - low, last - low + SPAN - GRAM + 1
        grams_here = mix((sums[first + GRAM : end + GRAM] - sums[first:end]) * back[first:end])
        at = _last_smallest(grams_here, SPAN - GRAM + 1)
        grams.append(grams_here[at])
        places.append(at + first + low)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), []
    place, which = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(grams)[which], [context_key(text, p) for p in place.tolist()]


def context_key(text: bytes, place: int) -> bytes:
    """128 bits of a context: its bytes and how many of them stand before the anchor. The digest is a cryptographic one, so contexts
    that were built to collide are told apart as well."""
    before = min(place, LEFT)
    return hashlib.blake2b(text[place - before : place + SPAN], digest_size=16, salt=before.to_bytes(2, "little")).digest()


_ANCHORS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("place", pa.int32()), ("stop", pa.int32()),
                      ("gram", pa.int64()), ("context", pa.binary())])


def _anchor_rows(docs: DataFrame) -> DataFrame:
    def find(columns):
        out = {name: [] for name in _ANCHORS.names}
        ids, hashes = columns["doc_id"].to_numpy(zero_copy_only=False), columns["text_hash"].to_numpy(zero_copy_only=False)
        for row, text in enumerate(columns["text"].to_pylist()):
            place, gram, context = anchors(text)
            out["doc_id"].append(np.full(len(place), ids[row]))
            out["text_hash"].append(np.full(len(place), hashes[row]))
            out["place"].append(place.astype(np.int32))
            out["stop"].append(np.minimum(place + SPAN, len(text)).astype(np.int32))
            out["gram"].append(gram.view(np.int64))
            out["context"] += context
        return {name: parts if name == "context" else np.concatenate(parts) for name, parts in out.items()}

    long = docs.where(F.octet_length("text") >= SPAN).select("doc_id", "text_hash", "text")
    return long.mapInArrow(per_batch(find, _ANCHORS), "doc_id long, text_hash long, place int, stop int, gram long, context binary")


def _common(hashes: np.ndarray, x: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Common extension of rows x and y by binary search over their prefix hashes."""
    limit = np.minimum(lengths[x], lengths[y])
    found = np.zeros(len(x), np.int64)
    step = 1 << (int(limit.max()).bit_length() - 1) if len(x) and limit.max() > 0 else 0
    while step:
        ahead = found + step
        fits = ahead <= limit
        ahead = np.where(fits, ahead, 0)
        found = np.where(fits & (hashes[x, ahead] == hashes[y, ahead]), ahead, found)
        step >>= 1
    return found


def _less(codes: np.ndarray, hashes: np.ndarray, lengths: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row x sorts before row y; equal rows by their number."""
    common = _common(hashes, x, y, lengths)
    end_x, end_y = common == lengths[x], common == lengths[y]
    last = codes.shape[1] - 1
    next_x, next_y = codes[x, np.minimum(common, last)], codes[y, np.minimum(common, last)]
    return np.where(end_x & end_y, x < y, np.where(end_x, True, np.where(end_y, False, next_x < next_y)))


def suffix_sort(codes: np.ndarray, lengths: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common extension with the row before) of byte rows, within each group; `group` is sorted.

    Bottom-up mergesort of all groups at once: a row's place in a merged run is its place in its own run plus the rows of the
    other run before it, found by binary search. The extension of a group's first row is -1.
    """
    n = len(codes)
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(begin, n))
    begin, size = np.repeat(begin, size), np.repeat(size, size)
    within = np.arange(n) - begin
    for _ in range(DRAWS):
        hashes = _prefix_hashes(codes, lengths)
        order = np.arange(n)
        width = 1
        while width < int(size.max(initial=0)):
            rows = np.flatnonzero(size > width)
            run = within[rows] // width
            other = run ^ 1
            low = begin[rows] + np.minimum(other * width, size[rows])
            start, high = low.copy(), begin[rows] + np.minimum((other + 1) * width, size[rows])
            while True:
                active = np.flatnonzero(low < high)
                if not len(active):
                    break
                middle = (low[active] + high[active]) // 2
                before = _less(codes, hashes, lengths, order[middle], order[rows[active]])
                low[active] = np.where(before, middle + 1, low[active])
                high[active] = np.where(before, high[active], middle)
            target = begin[rows] + (run & ~1) * width + (within[rows] - run * width) + (low - start)
            moved = order.copy()
            moved[target] = order[rows]
            order, width = moved, 2 * width
        shared = np.full(n, -1, np.int64)
        pairs = np.flatnonzero(within > 0)
        x, y = order[pairs - 1], order[pairs]
        shared[pairs] = _common(hashes, x, y, lengths)
        if _verified(codes, lengths, x, y, shared[pairs]):
            return order, shared
    raise RuntimeError("prefix hashes collide for every base that was drawn")


def _prefix_hashes(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Polynomial hashes of every prefix of every row, modulo two primes, to bases drawn for this call."""
    n, width = codes.shape
    inside = np.arange(width) < lengths[:, None]
    whole = np.zeros((n, width + 1), np.uint64)
    for prime in MODULI:
        base = int.from_bytes(os.urandom(8), "little") % (prime - 257) + 256
        power = np.array(list(accumulate(repeat(base, width - 1), lambda p, b: p * b % prime, initial=1)), np.uint64)
        terms = np.where(inside, (codes.astype(np.uint64) + np.uint64(1)) * power % np.uint64(prime), np.uint64(0))
        # a sum of some hundred terms below 2**31 stays far below 2**64
        whole[:, 1:] = whole[:, 1:] << np.uint64(32) | np.cumsum(terms, axis=1) % np.uint64(prime)
    return whole


def _verified(codes: np.ndarray, lengths: np.ndarray, x: np.ndarray, y: np.ndarray, shared: np.ndarray) -> bool:
    """The extensions of neighbours are right byte by byte, and the neighbours are in order."""
    within = np.arange(codes.shape[1]) < np.minimum(lengths[x], lengths[y])[:, None]
    if not np.array_equal(np.cumprod((codes[x] == codes[y]) & within, axis=1).sum(1), shared):
        return False
    last = codes.shape[1] - 1
    at = np.minimum(shared, last)
    ends = shared == lengths[x]
    return bool((ends | ((shared < lengths[y]) & (codes[x, at] < codes[y, at]))).all())


def _runs(order: np.ndarray, shared: np.ndarray, length: int) -> np.ndarray:
    run = np.empty(len(order), np.int64)
    run[order] = np.cumsum(shared < length)
    return run


def repeated_windows(left: list[bytes], right: list[bytes], group: np.ndarray) -> np.ndarray:
    """Row by d: the window with d bytes before the anchor also occurs in another row of the group (rows are sorted by it).

    `left` holds the bytes before an anchor, `right` those from it on.
    """
    n = len(left)
    sides = []
    for parts, width in (([x[::-1] for x in left], LEFT), (right, SPAN)):
        lengths = np.array([len(p) for p in parts])
        codes = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(n, width)
        sides.append(suffix_sort(codes, lengths, group))
    found = np.zeros((n, LEFT + 1), bool)
    for d in range(LEFT + 1):
        pair = _runs(*sides[0], d) * (n + 1) + _runs(*sides[1], SPAN - d)
        order = np.argsort(pair, kind="stable")
        same = pair[order][1:] == pair[order][:-1]
        found[order[1:][same], d] = True
        found[order[:-1][same], d] = True
    return found


def _intervals(flags: np.ndarray, place: int) -> list[tuple[int, int]]:
    """The stretches that a row's repeated windows cover."""
    starts = place - np.flatnonzero(flags)[::-1]
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > SPAN) + 1
    return [(int(part[0]), int(part[-1]) + SPAN) for part in np.split(starts, cut)]


_SPANS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of contexts that occur once, from contexts sorted by anchor string; whole groups are held together."""

    def solve(rows: dict[str, list]) -> pa.RecordBatch:
        first = {}
        for at, key in enumerate(zip(rows["gram"], rows["context"])):
            first.setdefault(key, at)  # a row that repeats a document gives its contexts again
        take = list(first.values())
        flags = repeated_windows([rows["before"][i] for i in take], [rows["after"][i] for i in take],
                                 np.array([rows["gram"][i] for i in take]))
        spans = [(rows["doc_id"][i], rows["text_hash"][i], lo, hi) for at, i in enumerate(take) if rows["single"][i]
                 for lo, hi in _intervals(flags[at], rows["place"][i])]
        return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*spans), _SPANS)] if spans else
                                          [pa.array([], f.type) for f in _SPANS], schema=_SPANS)

    held: dict[str, list] = {}
    for batch in batches:
        for name in batch.schema.names:
            held.setdefault(name, []).extend(batch.column(name).to_pylist())
        if len(held["gram"]) >= SORTED_ROWS:
            grams = held["gram"]
            cut = len(grams)
            while cut and grams[cut - 1] == grams[-1]:
                cut -= 1
            if cut:
                yield solve({name: values[:cut] for name, values in held.items()})
                held = {name: values[cut:] for name, values in held.items()}
    if held.get("gram"):
        yield solve(held)


_WINDOWS = pa.schema([*_ANCHORS.remove(5).remove(3), ("single", pa.bool_()), ("before", pa.int32()), ("key", pa.binary())])


def _windows(contexts: DataFrame) -> DataFrame:
    """Spans of contexts that occur once by counting all their windows as rows."""

    def unfold(columns):
        out = {name: [] for name in _WINDOWS.names}
        rows = zip(*(columns[c].to_pylist() for c in ("doc_id", "text_hash", "place", "gram", "single", "before", "after")))
        for doc, text, place, gram, single, before, after in rows:
            whole = before + after
            for d in range(max(0, SPAN - len(after)), len(before) + 1):
                start = len(before) - d
                for name, value in zip(_WINDOWS.names, (doc, text, place, gram, single, d, hashlib.blake2b(
                        whole[start : start + SPAN], digest_size=16).digest())):
                    out[name].append(value)
        return out

    rows = contexts.dropDuplicates(["gram", "context"]).mapInArrow(
        per_batch(unfold, _WINDOWS), "doc_id long, text_hash long, place int, gram long, single boolean, before int, key binary")
    again = rows.groupBy("gram", "before", "key").agg(F.count("*").alias("rows")).where("rows > 1").drop("rows")
    return rows.where("single").join(again, ["gram", "before", "key"]).select(
        "doc_id", "text_hash", (F.col("place") - F.col("before")).alias("lo"),
        (F.col("place") - F.col("before") + SPAN).alias("hi"))


def _with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` (doc_id, text_hash, ...) with each document's compressed text."""
    ids = wanted.select("doc_id", "text_hash")
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("packed", pa.binary())])

    def pack(columns):
        return columns | {"packed": [zlib.compress(t, 1) for t in columns["text"].to_pylist()]}

    texts = docs.join(ids, ["doc_id", "text_hash"], "left_semi").select("doc_id", "text_hash", "text").mapInArrow(
        per_batch(pack, schema), "doc_id long, text_hash long, packed binary")
    return texts.dropDuplicates(["doc_id", "text_hash"]).join(wanted, ["doc_id", "text_hash"])


_CONTEXTS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("place", pa.int32()), ("gram", pa.int64()),
                       ("context", pa.binary()), ("single", pa.bool_()), ("hot", pa.bool_()), ("before", pa.binary()),
                       ("after", pa.binary())])


def _cut(columns):
    out = {name: [] for name in _CONTEXTS.names}
    for doc, text_hash, packed, spots in zip(*(columns[c].to_pylist() for c in ("doc_id", "text_hash", "packed", "spots"))):
        text = zlib.decompress(packed)
        for s in spots:
            p = s["place"]
            values = (doc, text_hash, p, s["gram"], s["context"], s["single"], s["hot"], text[max(0, p - LEFT) : p], text[p : p + SPAN])
            for name, value in zip(_CONTEXTS.names, values):
                out[name].append(value)
    return out


def _kept(columns, with_text: bool):
    out = {name: [] for name in ("n_removed", "n_spans", "kept_sha256", "kept")}
    for packed, spans in zip(columns["packed"].to_pylist(), columns["spans"].to_pylist()):
        text = zlib.decompress(packed)
        cover = np.zeros(len(text) + 1, np.int32)
        np.add.at(cover, [s["lo"] for s in spans], 1)
        np.add.at(cover, [s["hi"] for s in spans], -1)
        gone = np.cumsum(cover)[:-1] > 0
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        out["n_removed"].append(int(gone.sum()))
        out["n_spans"].append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
        out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        out["kept"].append(kept.decode("utf-8", "ignore") if with_text else None)
    return columns | out


def remove_repeats(docs: DataFrame, with_text: bool = False, hot_contexts: int = HOT_CONTEXTS, doc_id: str = "doc_id",
                   text: str = "text", carry: tuple[str | Column, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row, with `with_text` the text that stays (`kept`), and the columns
    to `carry` along.

    Every copy of a repeated string is removed, the first one too, also when both are in one document. A null text is empty; empty
    texts and those under SPAN bytes lose nothing. Rows that repeat a doc_id stay rows, and equal texts count as copies. A
    character that is cut in half is left out of the text (not of the digest). Other columns are ignored; an empty table
    gives an empty result.
    """
    docs = small_batches(docs).select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 62))).alias("doc_id"),
                       F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b"")).alias("text"), *carry).withColumn(
        "text_hash", F.xxhash64("text"))
    carry = docs.columns[2:-1]
    rows = _anchor_rows(docs)
    counts = rows.groupBy("gram", "context").agg(F.count("*").alias("copies"))
    counts = materialize(counts, "suffix-counts")
    grams = counts.groupBy("gram").agg(F.count("*").alias("contexts"), F.min("copies").alias("fewest")).where(
        "contexts > 1 AND fewest = 1").select("gram", (F.col("contexts") > hot_contexts).alias("hot"))
    state = counts.join(grams, "gram", "left").where("copies > 1 OR hot IS NOT NULL")
    placed = materialize(rows.join(state, ["gram", "context"]), "suffix-placed")

    whole = placed.where("copies > 1").select(
        "doc_id", "text_hash", F.greatest(F.col("place") - LEFT, F.lit(0)).alias("lo"), F.col("stop").alias("hi"))
    chosen = placed.where("hot IS NOT NULL").groupBy("gram", "context").agg(
        *(F.first(c).alias(c) for c in ("doc_id", "text_hash", "place", "copies", "hot")))
    spots = chosen.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct(
        "place", "gram", "context", (F.col("copies") == 1).alias("single"), "hot")).alias("spots"))
    spots = materialize(spots, "suffix-spots")
    contexts = materialize(_with_texts(docs, spots).mapInArrow(
        per_batch(_cut, _CONTEXTS), "doc_id long, text_hash long, place int, gram long, context binary, single boolean, "
        "hot boolean, before binary, after binary"), "suffix-contexts")
    near = contexts.where("NOT hot").repartition("gram").sortWithinPartitions("gram").mapInArrow(
        _resolve, "doc_id long, text_hash long, lo int, hi int")
    spans = whole.unionByName(near).unionByName(_windows(contexts.where("hot")))
    spans = materialize(spans.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "suffix-spans")

    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                        ("kept_sha256", pa.string()), ("kept", pa.string())])
    cut = _with_texts(docs, spans).mapInArrow(
        per_batch(lambda columns: _kept(columns, with_text), schema),
        "doc_id long, text_hash long, n_removed long, n_spans long, kept_sha256 string, kept string")
    whole = docs.select("doc_id", "text_hash", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"), *carry,
                        *([F.col("text").cast("string").alias("whole")] if with_text else []))
    out = whole.join(cut, ["doc_id", "text_hash"], "left")
    return out.select(
        F.when(F.col("doc_id") != -(1 << 62), F.col("doc_id")).alias("doc_id"), "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        *([F.coalesce("kept", "whole").alias("kept")] if with_text else []), *carry)
