"""Grouped prefix join: documents whose word n-gram sets have a Jaccard similarity of at least a threshold.

Sets are ordered by one order of all n-grams, rare ones first, so two similar sets share an n-gram among the first
n - ceil(t * n) + 1. Documents with one size and one prefix form a group; n-grams of prefixes find pairs of groups, filtered
by size and position, and only the members of remaining pairs are verified on their whole sets.

Links are needed as connected components, so no group of copies is unfolded into all its pairs:
1. equal sets are one class; each class is compared with the first of its group, and each group with one leader per n-gram
   of its prefix, drawn by hash, so that a large group of near copies gets many leaders and falls together;
2. whatever pairs of a prefix n-gram are still in different components are compared as well, the largest component of the
   n-gram standing on one side only. Pairs within a component need no test: they cannot change the result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.session import materialize

from .common import as_bytes, components, per_batch, small_batches
from .texts import chunks, mix, shingle_sets

#: N-grams are ordered by the load of their bucket in a table of this many counters, then by hash.
ORDER_BUCKETS = 1 << 16
#: 64-bit words of a set's short parity sketch, which travels with its n-grams.
SKETCH_WORDS = 4
#: Words of the sketch that is compared inside the join of pairs across components.
WIDE_WORDS = 16
#: Up to so many document ids are broadcast to pick the texts that must be compared; beyond, the join shuffles.
BROADCAST_ROWS = 500_000


def _bytes_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    for _, parts in chunks(as_bytes(column)):
        yield from shingle_sets(parts, width)


def _bucket(values: np.ndarray) -> np.ndarray:
    return (values & np.uint64(ORDER_BUCKETS - 1)).astype(np.int64)


def _key(values: np.ndarray) -> bytes:
    """128 bits of a set, whatever its order."""
    n = len(values)
    return b"".join(int(mix(values ^ np.uint64(s)).sum(dtype=np.uint64) + np.uint64(n)).to_bytes(8, "big") for s in (0x5851F42D, 0xC2B2AE35))


def _sketch(values: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """The parity of the number of n-grams in each of 64 * words buckets.

    An n-gram that only one of two sets has flips one bit, so sketches differ in no more bits than the sets in n-grams.
    """
    odd = np.bincount((values >> np.uint64(32)).astype(np.int64) % (64 * words), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _long_sketch(values: np.ndarray) -> np.ndarray:
    """A sketch with a bit per n-gram at least, so that unlike sets differ in about half of them however large the sets are.

    Its number of words is a power of two: the halves of one, combined by exclusive or, are the sketch of half the words.
    """
    return _sketch(values, 1 << max(0, (len(values) - 1) // 64).bit_length())


def bucket_loads(docs: DataFrame, width: int, text: str = "text") -> np.ndarray:
    """How many n-gram occurrences (once per document) fall into each bucket; each task sends one row per bucket at most."""

    def count(batches):
        total = np.zeros(ORDER_BUCKETS, np.int64)
        for batch in batches:
            for values in _bytes_sets(batch.column(0), width):
                total += np.bincount(_bucket(values), minlength=ORDER_BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "load"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, "bucket long, load long").groupBy("bucket").agg(
        F.sum("load").alias("load")).collect()
    loads = np.zeros(ORDER_BUCKETS, np.int64)
    for row in rows:
        loads[row["bucket"]] = row["load"]
    return loads


def _described(docs: DataFrame, loads: np.ndarray, width: int, percent: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int32()), ("set_key", pa.binary()), ("group_key", pa.binary()),
                        ("prefix", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())), ("long_sketch", pa.list_(pa.int64()))])
    rank = np.argsort(np.argsort(loads, kind="stable"), kind="stable").astype(np.int32)

    def describe(columns):
        ns, set_keys, group_keys, prefixes, sketches, long_sketches = [], [], [], [], [], []
        for values in _bytes_sets(columns["text"], width):
            n = len(values)
            short = n - -(-percent * n // 100) + 1 if n else 0
            prefix = values[np.lexsort((values, rank[_bucket(values)]))[:short]]
            ns.append(n)
            set_keys.append(_key(values))
            group_keys.append(_key(np.append(prefix, np.uint64(n))))
            prefixes.append(prefix.view(np.int64))
            sketches.append(_sketch(values))
            long_sketches.append(_long_sketch(values))
        return {"doc_id": columns["doc_id"], "text_hash": columns["text_hash"], "n": ns, "set_key": set_keys, "group_key": group_keys, "prefix": prefixes,
                "sketch": sketches, "long_sketch": long_sketches}

    return docs.mapInArrow(per_batch(describe, schema), "doc_id long, text_hash long, n int, set_key binary, group_key binary, "
                            "prefix array<long>, sketch array<long>, long_sketch array<long>")


def _texts(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(set_key, packed) of the wanted classes: the compressed text of one document each, smaller than its set."""
    schema = pa.schema([("set_key", pa.binary()), ("packed", pa.binary())])

    def pack(batches):
        seen = set()
        for batch in batches:
            texts = as_bytes(batch.column(0))
            keys = [_key(values) for values in _bytes_sets(batch.column(0), width)]
            new = [at for at, key in enumerate(keys) if not (key in seen or seen.add(key))]
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in new], pa.binary()),
                                              pa.array([zlib.compress(texts[i], 1) for i in new], pa.binary())], schema=schema)

    some = wanted.select(F.col("doc_id").alias("wanted")).distinct()
    if some.count() <= BROADCAST_ROWS:
        some = F.broadcast(some)
    return docs.join(some, docs["doc_id"].eqNullSafe(some["wanted"]), "left_semi").select("text").mapInArrow(
        pack, "set_key binary, packed binary")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough, counted on the whole sets."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(columns):
        left, right = (column.dictionary_encode() for column in (columns["x"], columns["y"]))
        x, y = ([s for _, parts in chunks([zlib.decompress(t) for t in side.dictionary.to_pylist()])
                 for s in shingle_sets(parts, width)] for side in (left, right))
        kept = []
        for i, j in zip(left.indices.to_pylist(), right.indices.to_pylist()):
            both = len(np.intersect1d(x[i], y[j], assume_unique=True))
            kept.append(100 * both >= percent * (len(x[i]) + len(y[j]) - both))
        mask = pa.array(kept, pa.bool_())
        return {"a": columns["a"].filter(mask), "b": columns["b"].filter(mask)}

    x = texts.select(F.col("set_key").alias("kx"), F.col("packed").alias("x"))
    y = texts.select(F.col("set_key").alias("ky"), F.col("packed").alias("y"))
    return pairs.join(x, "kx").join(y, "ky").select("a", "b", "x", "y").mapInArrow(
        per_batch(compare, schema), "a long, b long")


def _tested(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int, label: str) -> DataFrame:
    keys = classes.select("class_id", "set_key", "doc_id")
    ends = pairs.select(F.col("a").alias("class_id")).unionByName(pairs.select(F.col("b").alias("class_id"))).distinct()
    texts = materialize(_texts(docs, keys.join(ends, "class_id", "left_semi"), width), f"{label}-texts")
    pairs = pairs.join(keys.select(F.col("class_id").alias("a"), F.col("set_key").alias("kx")), "a").join(
        keys.select(F.col("class_id").alias("b"), F.col("set_key").alias("ky")), "b")
    return materialize(_verified(pairs, texts, width, percent), f"{label}-links")


def _fits(percent: int) -> str:
    """Sizes and places a.n, a.at, b.n, b.at still allow the similarity."""
    return (f"100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) AND "
            f"{100 + percent} * least(a.n - a.at, b.n - b.at) >= {percent} * (a.n + b.n)")


def _near(percent: int) -> str:
    """Sketches a.sketch, b.sketch still allow the similarity."""
    apart = " + ".join(f"bit_count(a.sketch[{i}] ^ b.sketch[{i}])" for i in range(SKETCH_WORDS))
    return f"{100 + percent} * (a.n + b.n - ({apart})) >= {2 * percent} * (a.n + b.n)"


def _folded(sketch: str, other: str) -> str:
    """A long sketch, halved if the other one has half as many words."""
    return (f"IF(size({sketch}) = 2 * size({other}), zip_with(slice({sketch}, 1, size({other})), "
            f"slice({sketch}, size({other}) + 1, size({other})), (p, q) -> p ^ q), {sketch})")


def _wide(sketch: str) -> str:
    """A long sketch folded to WIDE_WORDS words at most: word j is the exclusive or of all words that are j modulo their number."""
    return (f"transform(sequence(0, least(size({sketch}), {WIDE_WORDS}) - 1), j -> aggregate(sequence(j, size({sketch}) - 1, {WIDE_WORDS}), "
            f"0L, (x, i) -> x ^ {sketch}[i]))")


def _near_ends(percent: int, sketch: str = "long_sketch") -> str:
    """Long sketches of the structs a, b still allow the similarity; those of sets more than twofold apart are not compared."""
    a, b = f"a.{sketch}", f"b.{sketch}"
    apart = (f"IF(greatest(size({a}), size({b})) > 2 * least(size({a}), size({b})), 0, aggregate(zip_with("
             f"{_folded(a, b)}, {_folded(b, a)}, (p, q) -> bit_count(p ^ q)), 0, (sum, bits) -> sum + bits))")
    return f"{100 + percent} * (a.n + b.n - {apart}) >= {2 * percent} * (a.n + b.n)"


def _plausible(pairs: DataFrame, ends: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) of classes whose long sketches allow the similarity, as (a, b)."""
    return pairs.toDF("x", "y").join(ends.toDF("x", "a"), "x").join(ends.toDF("y", "b"), "y").where(
        _near_ends(percent)).select(F.col("x").alias("a"), F.col("y").alias("b"))


def similar_components(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id",
                       text: str = "text", with_first: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: size of its set and the smallest doc_id its links reach.

    `with_first` adds text_hash and `first`: whether the row's doc_id and text are those that its component is named by, the
    smallest doc_id (null last) with the smallest hash of its texts. Rows that are equal in both are all first; a row without
    words is first.

    Sets hold the distinct `width`-word n-grams of the text with A-Z lower-cased; a text with fewer words has its whole
    sequence as the only one. Null, empty and blank texts have the size 0 and link with nothing. Rows that repeat a doc_id
    stay rows of their own; an unlinked row's component is its own doc_id. A null doc_id stays null and is no component's
    name unless all of its members have none. Other columns are ignored. An empty table gives an empty result.
    """
    docs = small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn(
        "text_hash", F.xxhash64("text"))
    loads = bucket_loads(docs, width)
    described = materialize(_described(docs, loads, width, percent), "jaccard-described")
    filled = described.where("n > 0")

    groups = materialize(filled.groupBy("group_key").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
                         .withColumn("group_id", F.monotonically_increasing_id()), "jaccard-groups")
    classes = filled.groupBy("set_key").agg(F.first("group_key").alias("group_key"), F.min(F.struct(
                                                F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"),
                                            F.first("sketch").alias("sketch"), F.first("long_sketch").alias("long_sketch"))
    classes = materialize(classes.join(groups.select("group_key", "group_id", "n"), "group_key").select(
        "set_key", "group_id", "first", F.col("first.doc_id").alias("doc_id"), "n", "sketch", "long_sketch", F.monotonically_increasing_id().alias("class_id")),
        "jaccard-classes")

    postings = groups.select("group_id", "n", F.posexplode("prefix").alias("at", "token"))
    shared = postings.groupBy("token").agg(F.count("*").alias("groups")).where("groups > 1").select("token")
    # a group may hold several classes: its n-grams matter even where no other group has them, but those classes share
    # all of them, so one n-gram, the first, is enough
    firsts = classes.groupBy("group_id").agg(F.min("class_id").alias("class_id"), F.count("*").alias("classes"))
    postings = materialize(postings.join(shared, "token").withColumn(
        "draw", F.xxhash64("token", "group_id")), "jaccard-postings")

    first = postings.groupBy("token").agg(F.min("draw").alias("draw"))
    leaders = postings.join(first, ["token", "draw"])
    stars = postings.alias("a").join(leaders.alias("b"), F.expr(
        "a.token = b.token AND a.group_id <> b.group_id AND " + _fits(percent))).select(
        F.col("a.group_id").alias("ga"), F.col("b.group_id").alias("gb")).distinct()
    stars = stars.join(firsts.select(F.col("group_id").alias("ga"), F.col("class_id").alias("a")), "ga").join(
        firsts.select(F.col("group_id").alias("gb"), F.col("class_id").alias("b")), "gb").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    inside = classes.join(firsts.where("classes > 1").withColumnRenamed("class_id", "a"), "group_id").where(
        "class_id <> a").select("a", F.col("class_id").alias("b"))
    ends = classes.select("class_id", F.struct("n", "long_sketch").alias("end"))
    pairs = materialize(_plausible(stars.unionByName(inside).distinct(), ends, percent), "jaccard-pairs")
    links = _tested(pairs, classes, docs, width, percent, "jaccard-first")
    roots = components(links, "jaccard-first")

    labelled = classes.join(roots.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "class_id", "group_id", "sketch", F.expr(_wide("long_sketch")).alias("wide"), F.coalesce("root", "class_id").alias("root"))
    parts = labelled.select("group_id", "root").distinct()
    split = parts.groupBy("group_id").agg(F.count("*").alias("roots")).where("roots > 1").select("group_id")
    own = groups.join(split, "group_id", "left_semi").select(
        "group_id", "n", F.lit(0).alias("at"), F.expr("prefix[0]").alias("token"))
    rest = postings.select("group_id", "n", "at", "token").unionByName(own).distinct()
    per_root = rest.join(parts, "group_id").groupBy("token", "root").agg(F.count("*").alias("rows"))
    open_tokens = per_root.groupBy("token").agg(F.count("*").alias("roots"), F.max(F.struct(
        "rows", "root")).alias("most")).where("roots > 1").select("token", F.col("most.root").alias("largest"))
    rest = materialize(rest.join(open_tokens, "token").join(labelled, "group_id").drop("group_id"), "jaccard-rest")
    cross = rest.where("root <> largest").alias("a").join(rest.alias("b"), F.expr(
        "a.token = b.token AND a.root <> b.root AND (b.root = b.largest OR a.class_id < b.class_id) AND "
        + _fits(percent) + " AND " + _near(percent) + " AND " + _near_ends(percent, "wide")))
    cross = cross.select(F.least("a.class_id", "b.class_id").alias("a"), F.greatest("a.class_id", "b.class_id").alias("b"))
    cross = _plausible(cross.distinct().join(pairs, ["a", "b"], "left_anti"), ends, percent)
    cross = materialize(cross, "jaccard-cross")
    more = _tested(cross, classes, docs, width, percent, "jaccard-second")

    # links of the first round count as one star per component
    stars = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = components(stars.unionByName(more), "jaccard-all")
    named = classes.join(roots.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "set_key", "first", F.coalesce("root", "class_id").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("named_by"))
    named = named.drop("first").join(smallest, "root").select("set_key", "named_by")
    out = described.select("doc_id", "text_hash", "n", "set_key").join(named, "set_key", "left")
    own = F.col("doc_id").eqNullSafe(F.col("named_by.doc_id")) & (F.col("text_hash") == F.col("named_by.text_hash"))
    return out.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("named_by.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        *(["text_hash", ((F.col("n") == 0) | own).alias("first")] if with_first else []))
