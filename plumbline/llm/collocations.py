"""Collocations per language, with phrases counted by a multikey three-way quicksort of suffix pointers.

1. Each task cuts its texts into pieces and words, block by block. A pointer stands for a word and up to `longest - 1` words after it in
   its piece. Pointers are routed by all leading words they are sorted by, one for every phrase length, after equal ones of a block
   were merged into one with a weight; so a phrase that fills a third of the corpus is one pointer per block and bucket.
2. Each bucket is sorted by a three-way quicksort on the word at the current depth: every open partition splits into smaller, equal and
   greater pointers, and equal ones go one word deeper. The weight of a partition that is equal to full depth is a phrase's count. A partition
   whose weight is under the wanted count is abandoned at once, with everything in it (pointers whose phrase shares its hash slot with
   too little weight before the first step). All open partitions take a
   step together, so the steps are array operations whatever the number of partitions.
3. Counts of frequent phrases (every part of a frequent phrase is frequent) are joined with those of their parts for the scores.

A block carries its own words with its pointers, so there is no dictionary of the corpus anywhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.session import materialize

from .texts import mix

#: Bytes of text of one language that a task merges before it routes them, and bytes of text behind one bucket on average.
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
#: Stretches of ranking that are sorted by themselves before the languages are ranked.
RANK_PARTS = 64

#: A-Z become a-z, and whatever ends a piece becomes a newline (0x0A).
_TABLE = bytearray(range(256))
_TABLE[ord("A") : ord("Z") + 1] = bytes(range(ord("a"), ord("z") + 1))
for _end in b".,;:!?\x0a\x0b\x0c\x0d":
    _TABLE[_end] = 0x0A
_TABLE = bytes(_TABLE)


def phrases_by_quicksort(words: list[np.ndarray], weight: np.ndarray, least: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each phrase, weight of all its rows) for phrases with a weight of `least` or more.

    `words` are columns of word numbers, the phrase of a row being its values from the first column to the last.
    """
    rows = np.random.default_rng(seed).permutation(len(weight)).astype(np.int32)  # so that any pointer of a partition is a fair pivot
    weight, part = weight[rows], np.zeros(len(rows), np.int32)
    depth = np.zeros(1, np.int8)
    at = words[0][rows]
    done_rows, done_weights = [], []
    while len(rows):
        pivot = np.empty(len(depth), at.dtype)
        pivot[part] = at
        middle = pivot[part]
        label = 3 * part + 1 + (at > middle) - (at < middle)
        total = np.bincount(label, weights=weight, minlength=3 * len(depth))
        is_open = total >= least
        deeper = np.repeat(depth, 3)
        deeper[1::3] += 1
        done = is_open & (deeper == len(words))
        if done.any():
            some = np.full(3 * len(depth), -1, np.int32)
            some[label] = rows
            done_rows.append(some[done])
            done_weights.append(total[done].astype(np.int64))
            is_open &= ~done
        keep = is_open[label]
        rows, weight, label, at = rows[keep], weight[keep], label[keep], at[keep]
        part = (np.cumsum(is_open, dtype=np.int32) - 1)[label]
        depth = deeper[is_open]
        moved = np.flatnonzero(label % 3 == 1)  # equal to the pivot: compared by their next word from now on
        by = deeper[label[moved]]
        for d in range(1, len(words)):
            mine = moved[by == d]
            at[mine] = words[d][rows[mine]]
    if not done_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(done_rows).astype(np.int64), np.concatenate(done_weights)


def _merged(columns: list[np.ndarray], n_words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows of word numbers below n_words, and how often each stands there."""
    if n_words ** len(columns) < 1 << 63:
        key = columns[0].astype(np.int64)
        for column in columns[1:]:
            key = key * n_words + column
        key, count = np.unique(key, return_counts=True)
        out = []
        for _ in columns:
            key, last = np.divmod(key, n_words)
            out.append(last.astype(np.int32))
        return out[::-1], count
    rows, count = np.unique(np.stack(columns, axis=1), axis=0, return_counts=True)
    return [rows[:, c].astype(np.int32) for c in range(len(columns))], count


def _narrow(values: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as they need."""
    highest = int(values.max(initial=0))
    return values.astype("<u1" if highest < 1 << 8 else "<u2" if highest < 1 << 16 else "<u4")


def _wide(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // max(rows, 1) or 1}")


_BLOCKS = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("n_words", pa.int64()), ("n", pa.int32()), ("words", pa.binary()),
                     ("pointers", pa.binary()), ("weights", pa.binary())])


def _numbered(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    """(numbers of the words in order, from 1; the word of each number)."""
    words = pc.ascii_split_whitespace(pa.array([data], pa.large_binary()).cast(pa.large_string())).flatten()
    words = words.filter(pc.greater(pc.binary_length(words), 0)).dictionary_encode()
    return words.indices.to_numpy().astype(np.int32) + 1, [b"", *words.dictionary.cast(pa.large_binary()).to_pylist()]


def _block(lang: str, texts: list[bytes], longest: int, buckets: int) -> Iterator[tuple]:
    """Rows of _BLOCKS: the merged pointers of some texts by bucket."""
    data = b"\n".join(texts).translate(_TABLE)
    array = np.frombuffer(data, np.uint8)
    end = array == 0x0A
    space = end | (array == 0x20) | (array == 0x09)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space])) & ~space)
    if not len(edge):
        return
    piece = np.cumsum(end, dtype=np.int32)[edge]
    number, names = _numbered(data)  # 0: no word
    del array, end, space, edge
    n = len(number)
    after = [number]
    for k in range(1, longest):
        following = np.zeros(n, np.int32)
        following[: max(0, n - k)] = np.where(piece[: max(0, n - k)] == piece[k:], number[k:], 0) if n > k else 0
        after.append(following)
    parts = []
    for size in range(1, longest + 1):
        whole = after[size - 1] > 0
        columns, count = _merged([column[whole] for column in after[:size]], len(names))
        parts.append((columns + [np.zeros(len(count), np.int32)] * (longest - size), count))
    columns = [np.concatenate([p[0][c] for p in parts]) for c in range(longest)]
    weight = np.concatenate([p[1] for p in parts])
    del after, parts
    hashes = mix(np.array([zlib.crc32(w) for w in names], np.uint64))
    route = np.full(len(weight), np.uint64(zlib.crc32(lang.encode())))
    for column in columns:
        route = route * np.uint64(0x9E3779B97F4A7C15) + hashes[column]
    bucket = (mix(route) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    del route
    order = np.argsort(bucket, kind="stable")
    dealt = bucket[order]
    begins = np.flatnonzero(np.concatenate([[True], dealt[1:] != dealt[:-1]]))
    counted = n
    place = np.zeros(len(names), np.int32)
    for low, high in zip(begins.tolist(), [*begins[1:].tolist(), len(order)]):
        mine = order[low:high]
        own = np.stack([column[mine] for column in columns])
        place[own] = 1
        place[0] = 0
        known = np.flatnonzero(place)
        place[known] = np.arange(1, len(known) + 1)
        yield (int(dealt[low]), lang, counted, high - low, b"\n".join([names[w] for w in known.tolist()]),
               _narrow(place[own]).tobytes(), _narrow(weight[mine]).tobytes())
        place[known] = 0
        counted = 0  # the words of a block are told once


def _route(rows: DataFrame, longest: int, buckets: int) -> DataFrame:
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            out = list(_block(lang, held.pop(lang), longest, buckets))
            size.pop(lang)
            for k in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, f.type) for x, f in zip(zip(*out[k : k + 256]), _BLOCKS)], schema=_BLOCKS)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text) + 1
                if size[lang] >= BLOCK_BYTES:
                    yield from flush(lang)
                elif sum(size.values()) >= 2 * BLOCK_BYTES:
                    yield from flush(max(size, key=size.get))
        for lang in list(held):
            yield from flush(lang)

    return rows.mapInArrow(route, "bucket int, lang string, n_words long, n int, words binary, pointers binary, weights binary")


_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("f", pa.int64())])


def _count(lang: str, blocks: list[tuple], longest: int, least: int) -> pa.RecordBatch:
    """Frequent phrases of one bucket and language."""
    lists = [words.split(b"\n") for _, words, *_ in blocks]
    coded = pa.array([w for words in lists for w in words], pa.binary()).dictionary_encode()
    number = np.split(coded.indices.to_numpy().astype(np.int32) + 1, np.cumsum([len(words) for words in lists])[:-1])
    names = coded.dictionary.to_pylist()
    pointers, weights = [], []
    for (n, _, raw, raw_weights), own in zip(blocks, number):
        pointers.append(np.concatenate([[0], own]).astype(np.int32)[_wide(raw, longest * n)].reshape(longest, n))
        weights.append(_wide(raw_weights, n).astype(np.float64))
    columns = [np.concatenate([p[c] for p in pointers]) for c in range(longest)]
    weight = np.concatenate(weights)
    del pointers, number, lists, coded, weights
    columns, weight = _possible(columns, weight, least)
    rows, total = phrases_by_quicksort(columns, weight, least)
    found = [[names[w - 1] for w in row if w] for row in zip(*(column[rows].tolist() for column in columns))]
    return pa.RecordBatch.from_arrays([
        pa.array([lang] * len(found), pa.string()), pa.array([b" ".join(p) for p in found], pa.binary()).cast(pa.string()),
        pa.array([len(p) for p in found], pa.int32()), pa.array(total, pa.int64())], schema=_COUNTS)


def _possible(columns: list[np.ndarray], weight: np.ndarray, least: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The pointers whose phrase may have the wanted weight: a phrase is no heavier than all that share a slot with it."""
    slots = np.uint64(1 << max(10, (4 * len(weight)).bit_length()))
    slot = np.zeros(len(weight), np.uint64)
    for column in columns:
        slot = (slot + column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        slot ^= slot >> np.uint64(29)
    slot = (slot % slots).astype(np.int64)
    keep = np.bincount(slot, weights=weight, minlength=int(slots))[slot] >= least
    return [column[keep] for column in columns], weight[keep]


def count_phrases(docs: DataFrame, longest: int = 3, least: int = 10, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, phrase, size, f): phrases of 1 to `longest` words that occur `least` times or more in a language, words joined by a space;
    and one row or more per language with a null phrase, size 0 and f, which add up to its number of words.

    A-Z are lower-cased; pieces end at `.,;:!?` and 0x0A to 0x0D, words within them at space and tab; phrases lie within a piece,
    overlaps count. A null or empty text has no words; a null language is `und`. Repeated rows count each time. Other columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(-(-size // BUCKET_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, words = None, [], {}
        for batch in batches:
            for bucket, language, n_words, *block in zip(*(column.to_pylist() for column in batch.columns)):
                if (bucket, language) != of and held:
                    yield _count(of[1], held, longest, least)
                    held = []
                of = (bucket, language)
                held.append(tuple(block))
                words[language] = words.get(language, 0) + n_words
        if held:
            yield _count(of[1], held, longest, least)
        for language, n in words.items():
            yield pa.RecordBatch.from_arrays([pa.array([language]), pa.nulls(1, pa.string()), pa.array([0], pa.int32()),
                                              pa.array([n], pa.int64())], schema=_COUNTS)

    dealt = _route(rows, longest, buckets).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "lang")
    return dealt.mapInArrow(sort, "lang string, phrase string, size int, f long")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, inside: int = 50, top: int = 2_000, lang: str = "lang",
                 text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of 2 to `longest` words by score, then a (both
    descending), then phrase.

    a is the count of the phrase, l and r those of its two parts at the cut with the lowest score floor(1000000 * a * a / (l * r)), the
    first cut on ties; n the words of the language. A phrase is left out if its words lie inside a longer one that has at least `inside`
    percent of its count. Arithmetic is exact to 38 digits. What counts as a word and what odd rows give is said at `count_phrases`.
    """
    counts = materialize(count_phrases(docs, longest, least, lang, text), "collocation-counts")
    n = counts.where("phrase IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))
    known = counts.where("phrase IS NOT NULL")
    long = known.where("size > 1").withColumn("w", F.split("phrase", " "))
    cuts = long.select("lang", "phrase", F.col("f").alias("a"), "size", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "size", "k", F.concat_ws(" ", F.slice("w", 1, F.col("k"))).alias("left"),
                       F.concat_ws(" ", F.slice("w", F.col("k") + 1, F.col("size") - F.col("k"))).alias("right"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(
        known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    exact = {c: f"CAST({c} AS DECIMAL(15, 0))" for c in "alr"}
    cuts = cuts.withColumn("score", F.expr(
        f"(CAST(1000000 AS DECIMAL(7, 0)) * ({exact['a']} * {exact['a']})) div ({exact['l']} * {exact['r']})"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # the shorter phrases inside each phrase, with the greatest count of those that hold them
    spans = F.expr("flatten(transform(sequence(2, size - 1), s -> transform(sequence(1, size - s + 1), "
                   "b -> concat_ws(' ', slice(w, b, s)))))")
    held = long.where("size > 2").select("lang", F.explode(spans).alias("phrase"), "f").groupBy("lang", "phrase").agg(
        F.max("f").alias("longer"))
    kept = lowest.join(held, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {int(inside)} * a")
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # ranks of parts first: no language is sorted in one task, only the first rows of its parts
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    best = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).withColumn("rank", F.row_number().over(
        Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
