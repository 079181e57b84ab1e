"""Token ids as raw binary shards, found by document key through a minimal perfect hash index.

A store is a folder in the shared file system:

* `ids-<shard>.bin`: the ids of its documents one after the other, little-endian, 16 bits each where the vocabulary allows, else 32.
  Shards follow each other in ascending doc_id, and so do documents within a shard. `ids-<shard>.off` holds the place of each
  document's first id and the end, as 64-bit numbers.
* `index-<bucket>.mph`: a minimal perfect hash over the bucket's keys. A key's slot holds its 64-bit fingerprint and its segments:
  (shard, first document, number of documents). A key is looked up by a few bit tests whatever the number of keys.
* `shards`: one row per shard (shard, n_docs, n_ids, start), start being the ids of all shards before it.

The hash is built level by level: a level has a bit per key and more, keys that hit a bit alone are settled, the others go on to the
next level with another hash. The number of bits set before a key's own bit is its slot. Keys are hashed to buckets, so no
index file grows with the corpus, and a key is found without any search over shards.

Tasks write to a name of their own and move the finished file to its place. Contents depend on the rows alone, so an attempt that is
repeated, on whichever executor, puts the same bytes there.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.session import materialize, shared_dir

from .common import as_bytes
from .texts import chunks, mix

#: Bytes of text a shard holds on average, and keys an index file holds on average.
SHARD_BYTES, INDEX_KEYS = 128 << 20, 1 << 20
#: Bits of a level for each of its keys.
SPARE = 2
#: Ids are read and handed on in stretches of about so many bytes.
STRETCH = 8 << 20
#: Bytes of text encoded together.
ENCODED_BYTES = 2 << 20
#: Words whose ids a task remembers; when there are more, it starts anew.
REMEMBERED = 1 << 19
MAGIC = 0x3148504D534449


# ---------------------------------------------------------------------------------------------------------------- encoding

#: Words of these characters alone are cut into letters, digits and signs as the tokenizer below cuts them: all of them are single
#: code points that normalisation leaves alone. An apostrophe or `<` needs the tokenizer's own rules.
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:;=-@\[-`{-~"
_PLAIN = re.compile(f"([{_LETTERS}]*+)[{_LETTERS}0-9{_SIGNS}]*+")
_PIECES = re.compile(f"[{_LETTERS}]+|[0-9]|[{_SIGNS}]+")

#: Normaliser and splitting (fixed values of the tokenizer file) that never join what white space separates.
_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTING = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed",
     "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte: itself where it is printable, else the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, without special tokens at the ends.

    Where the tokenizer never joins what white space separates, texts are encoded word by word and words are remembered; their letters,
    digits and signs go to the library's own model. Any other tokenizer, and any other word, is left to the library whole.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        read = json.loads(spec)
        added = [t["content"] for t in read.get("added_tokens") or []]
        self.by_word = (read.get("normalizer") == _NORMALIZER and read.get("pre_tokenizer") == _SPLITTING
                        and not read.get("post_processor") and not read["model"].get("dropout")
                        and not any(re.search(r"\s", t) or _PLAIN.fullmatch(t) for t in added))
        self.dtype = id_type(spec)
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.letters = _byte_letters()

    def _raw(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.dtype == '<u2' else 'I'}", *ids)

    def _piece(self, piece: str) -> bytes:
        # printable ASCII stands for itself
        spelt = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return self._raw([token.id for token in self.tokenizer.model.tokenize(spelt)])

    def _learn(self, words: list[bytes]) -> None:
        odd, pieces = [], self.pieces
        if len(self.words) + len(words) > REMEMBERED:
            self.words.clear()
        if len(pieces) > REMEMBERED:
            pieces.clear()
        for word in words:
            text = word.decode()
            plain = _PLAIN.fullmatch(text)
            if not plain:
                odd.append(word)
                continue
            text = text.lower()
            found = b""
            # most words are letters, perhaps with signs behind them
            for piece in (text,) if plain[1] == plain[0] else _PIECES.findall(text):
                ids = pieces.get(piece)
                if ids is None:
                    ids = pieces[piece] = self._piece(piece)
                found += ids
            self.words[word] = found
        for word, found in zip(odd, self.tokenizer.encode_batch([w.decode() for w in odd], add_special_tokens=False)):
            self.words[word] = self._raw(found.ids)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as raw bytes."""
        if not self.by_word:
            return [self._raw(e.ids) for e in self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        words = split.flatten()
        some = pc.greater(pc.binary_length(words), 0)
        # words of each text, the empty ones at its ends left out
        upto = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        coded = words.filter(some).dictionary_encode()
        names = coded.dictionary.cast(pa.large_binary()).to_pylist()
        new = [w for w in names if w not in self.words]
        if new:
            # a cleared memory forgets words that these texts need as well
            self._learn(new if len(self.words) + len(new) <= REMEMBERED else names)
        raw = [self.words[w] for w in names]
        width = np.dtype(self.dtype).itemsize
        sizes = np.array([len(r) // width for r in raw], np.int64)
        ids, begins = np.frombuffer(b"".join(raw), self.dtype), np.cumsum(sizes) - sizes
        word = coded.indices.to_numpy()
        counts = sizes[word]
        ends = np.concatenate([[0], np.cumsum(counts)])
        whole = ids[np.repeat(begins[word] - ends[:-1], counts) + np.arange(ends[-1])]
        cuts = ends[upto].tolist()
        return [whole[low:high].tobytes() for low, high in zip(cuts, cuts[1:])]


def id_type(spec: str) -> str:
    """The narrowest type that holds every id of a tokenizer."""
    read = json.loads(spec)
    highest = max([len(read["model"]["vocab"]) - 1, *(t["id"] for t in read.get("added_tokens") or [])])
    return "<u2" if highest < 1 << 16 else "<u4"


# ------------------------------------------------------------------------------------------------------------------- files

def _files(path: str):
    """(file system, path) for a folder named the way Spark names it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


class _NewFile:
    """A file that appears under its name when it is complete."""

    def __init__(self, folder: str, name: str):
        self.system, folder = _files(folder)
        self.system.create_dir(folder, recursive=True)
        self.name = f"{folder}/{name}"
        self.hidden = f"{folder}/_{name}-{uuid.uuid4().hex}"
        self.stream = self.system.open_output_stream(self.hidden)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def finish(self) -> None:
        self.stream.close()
        self.system.move(self.hidden, self.name)


def _whole(folder: str, name: str) -> bytes:
    system, path = _files(folder)
    with system.open_input_file(f"{path}/{name}") as file:
        return file.read()


# ---------------------------------------------------------------------------------------------------- minimal perfect hash

def _places(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix(hashes + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(bits)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    """64 bits for each 64-bit key, different for different keys."""
    return mix(keys.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))


@dataclass
class PerfectHash:
    """Levels of bits; a key's slot is the number of bits set before its own."""

    sizes: np.ndarray
    words: np.ndarray
    before: np.ndarray

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        """Over different 64-bit values."""
        sizes, words = [], []
        while len(hashes):
            bits = -(-SPARE * len(hashes) // 64) * 64
            place = _places(hashes, len(sizes), bits)
            alone = np.bincount(place, minlength=bits) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(bits)
            hashes = hashes[~alone[place]]
        words = np.concatenate(words) if words else np.zeros(0, "<u8")
        return cls(np.array(sizes, "<i8"), words, cls._counted(words))

    @staticmethod
    def _counted(words: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1]

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each value, -1 where no level has a bit for it. Values that were not built in may get a slot as well."""
        slot = np.full(len(hashes), -1, np.int64)
        left, first = np.arange(len(hashes)), 0
        for level, bits in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            place = _places(hashes[left], level, bits)
            word, bit = self.words[first + (place >> 6)], (place & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            slot[left[hit]] = (self.before[first + (place >> 6)] + below)[hit]
            left, first = left[~hit], first + bits // 64
        return slot


@dataclass
class Index:
    """One index file: the perfect hash, a fingerprint per slot, and each slot's segments; those of the null key stand apart."""

    hash: PerfectHash
    prints: np.ndarray
    begins: np.ndarray
    segments: np.ndarray
    of_null: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray, segments: np.ndarray, of_null: np.ndarray) -> Index:
        """`keys` are sorted and repeat once per row of `segments` (shard, document, documents)."""
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        prints = fingerprints(keys[new])
        built = PerfectHash.build(prints)
        slot = built.slots(prints)
        order = np.argsort(slot)
        counts = np.diff(np.append(new, len(keys)))[order]
        rows = np.repeat(new[order] - np.cumsum(counts) + counts, counts) + np.arange(len(keys))
        return cls(built, prints[order], np.concatenate([[0], np.cumsum(counts)]), segments[rows], of_null)

    def pack(self) -> bytes:
        head = [MAGIC, len(self.hash.sizes), len(self.hash.words), len(self.prints), len(self.segments), len(self.of_null)]
        parts = (np.array(head), self.hash.sizes, self.hash.words, self.prints, self.begins, self.segments, self.of_null)
        return b"".join(np.ascontiguousarray(p, "<u8" if p.dtype.kind == "u" else "<i8").tobytes() for p in parts)

    @classmethod
    def unpack(cls, data: bytes) -> Index:
        numbers = np.frombuffer(data, "<i8")
        if len(numbers) < 6 or numbers[0] != MAGIC:
            raise ValueError("not an index file")
        levels, words, keys, segments, of_null = numbers[1:6].tolist()
        parts = np.split(numbers[6:], np.cumsum([levels, words, keys, keys + 1, 3 * segments]))
        if len(parts[5]) != 3 * of_null:
            raise ValueError("an index file of another length than it says")
        bits = parts[1].view("<u8")
        return cls(PerfectHash(parts[0], bits, PerfectHash._counted(bits)), parts[2].view("<u8"), parts[3],
                   parts[4].reshape(-1, 3), parts[5].reshape(-1, 3))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in keys, row of segments) for every segment of every key that is there."""
        prints = fingerprints(keys)
        slot = self.hash.slots(prints)
        there = np.flatnonzero(slot >= 0)
        there = there[self.prints[slot[there]] == prints[there]]
        slot = slot[there]
        counts = self.begins[slot + 1] - self.begins[slot]
        rows = np.repeat(self.begins[slot] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        return np.repeat(there, counts), rows


# -------------------------------------------------------------------------------------------------------------------- store

@dataclass(frozen=True)
class TokenStore:
    """Where a store is, how many index files it has, and how ids are written."""

    folder: str
    buckets: int
    dtype: str


_RECORDS = pa.schema([("shard", pa.int32()), ("record", pa.int64()), ("doc_id", pa.int64()), ("n_ids", pa.int64())])


def _write_shards(rows: DataFrame, folder: str, spec: str, end: int | None) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(spec)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = None, TaskContext.get().partitionId()
        offsets = [np.zeros(1, np.int64)]
        for batch in batches:
            if not batch.num_rows:
                continue
            if encoder is None:
                encoder, payload = Encoder(sent.value), _NewFile(folder, f"ids-{shard:08d}.bin")
                tail = encoder._raw([] if end is None else [end])
                width = np.dtype(encoder.dtype).itemsize
            sizes = []
            for _, texts in chunks(as_bytes(batch.column(1)), ENCODED_BYTES):
                for ids in encoder.encode(texts):
                    payload.write(ids + tail)
                    sizes.append((len(ids) + len(tail)) // width)
            sizes = np.array(sizes, np.int64)
            record = sum(map(len, offsets)) - 1
            offsets.append(offsets[-1][-1] + np.cumsum(sizes))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(sizes), shard, np.int32)), pa.array(np.arange(record, record + len(sizes))), batch.column(0),
                pa.array(sizes)], schema=_RECORDS)
        if encoder is not None:
            payload.finish()
            places = _NewFile(folder, f"ids-{shard:08d}.off")
            places.write(np.concatenate(offsets).astype("<i8").tobytes())
            places.finish()

    return rows.mapInArrow(write, "shard int, record long, doc_id long, n_ids long")


def _write_index(segments: DataFrame, folder: str) -> DataFrame:
    """Rows (bucket, doc_id, shard, record, copies) are sorted by the first three."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            bucket = rows.column("bucket")[0].as_py()
            where = np.stack([rows.column(c).to_numpy() for c in ("shard", "record", "copies")], axis=1).astype(np.int64)
            none = rows.column("doc_id").is_null().to_numpy()
            keys = rows.column("doc_id").fill_null(0).to_numpy()[~none]
            file = _NewFile(folder, f"index-{bucket:08d}.mph")
            file.write(Index.build(keys, where[~none], where[none]).pack())
            file.finish()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([len(keys)], pa.int64())], ["bucket", "n_segments"])

        for batch in batches:
            for part in _split(batch, "bucket"):
                if held and held[-1].column("bucket")[0] != part.column("bucket")[0]:
                    yield close()
                held.append(part)
        if held:
            yield close()

    return segments.mapInArrow(build, "bucket int, n_segments long")


def _split(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    """Stretches of rows with one value of a column."""
    if batch.num_rows:
        values = batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for low, high in zip(cuts, cuts[1:]):
            yield batch.slice(low, high - low)


def _bucket(buckets: int):
    # the same remainder that repartition(buckets, "doc_id") deals rows by
    return F.pmod(F.hash("doc_id"), F.lit(buckets)).alias("bucket")


def write_store(docs: DataFrame, spec: str, end: int | None = 2, doc_id: str = "doc_id", text: str = "text",
                folder: str | None = None) -> TokenStore:
    """Encode whole texts with a tokenizer (`spec`: the content of its JSON file), append `end`, and write shards and index.

    Documents are in ascending doc_id, null first; rows that repeat a doc_id follow each other in the order of a hash of their text, and
    equal rows are interchangeable. A null text is empty: only `end` is written for it. A doc_id that very many rows repeat is cut over
    shards by that hash and by row. Other columns are ignored; an empty table gives a store without shards. `folder` is a new folder
    in the shared file system, by default one below spark.checkpoint.dir.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/plumbline/tokens-{uuid.uuid4().hex}"
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = max(-(-size // SHARD_BYTES), 2 * spark.sparkContext.defaultParallelism)
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("row")]
    placed = rows.withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id()).repartitionByRange(
        n_shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    records = materialize(_write_shards(placed, folder, spec, end), "token-records")

    shards = records.groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum("n_ids").alias("n_ids"))
    # one row per shard: the window sums a table that is a millionth of the ids
    shards.selectExpr("shard", "n_docs", "n_ids", "coalesce(sum(n_ids) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING "
                      "AND 1 PRECEDING), 0L) AS start").write.parquet(f"{folder}/shards")

    buckets = max(-(-records.count() // INDEX_KEYS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    segments = records.groupBy("doc_id", "shard").agg(F.min("record").alias("record"), F.count("*").alias("copies"))
    segments = segments.select(_bucket(buckets), "doc_id", "shard", "record", "copies").repartition(
        buckets, "doc_id").sortWithinPartitions("bucket", "doc_id", "shard")
    materialize(_write_index(segments, folder), "token-index")
    return TokenStore(folder, buckets, id_type(spec))


_FOUND = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("record", pa.int64()), ("copies", pa.int64())])


def locate(keys: DataFrame, store: TokenStore, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, shard, record, copies) of the keys that the index knows, one row per stretch of documents in a shard.

    Keys count once however often they are given; unknown keys give nothing, a null key finds the documents without an id.
    """

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, index = None, None
        for batch in batches:
            for part in _split(batch, "bucket"):
                if number != part.column("bucket")[0].as_py():
                    number = part.column("bucket")[0].as_py()
                    try:
                        index = Index.unpack(_whole(store.folder, f"index-{number:08d}.mph"))
                    except FileNotFoundError:
                        index = None  # no key fell in this bucket
                if index is None:
                    continue
                keys = part.column("doc_id")
                none = keys.is_null().to_numpy(zero_copy_only=False)
                place, row = index.find(keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
                place, row = place[~none[place]], row[~none[place]]
                for ids, where in ((keys.take(pa.array(place)), index.segments[row]),
                                   (pa.nulls(len(index.of_null) * int(none.any()), pa.int64()), index.of_null[: len(index.of_null) * int(none.any())])):
                    yield pa.RecordBatch.from_arrays([ids, pa.array(where[:, 0].astype(np.int32)), pa.array(where[:, 1]),
                                                      pa.array(where[:, 2])], schema=_FOUND)

    wanted = keys.select(F.col(doc_id).cast("long").alias("doc_id")).distinct()
    return wanted.select(_bucket(store.buckets), "doc_id").repartition(store.buckets, "doc_id").sortWithinPartitions(
        "bucket").mapInArrow(look_up, "doc_id long, shard int, record long, copies long")


def fetch(keys: DataFrame, store: TokenStore, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, start, ids) of every document whose key is asked for: start is the number of ids of all documents before it in the
    store, ids are its ids as little-endian unsigned 32-bit integers, read from the shard at the place that the index names."""
    schema = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("place", pa.int64()), ("ids", pa.binary())])
    width = np.dtype(store.dtype).itemsize

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _split(batch, "shard"):
                shard = part.column("shard")[0].as_py()
                places = np.frombuffer(_whole(store.folder, f"ids-{shard:08d}.off"), "<i8")
                first, copies = part.column("record").to_numpy(), part.column("copies").to_numpy()
                record = np.repeat(first - np.cumsum(copies) + copies, copies) + np.arange(copies.sum())
                keys = part.column("doc_id").take(pa.array(np.repeat(np.arange(len(first)), copies)))
                system, path = _files(store.folder)
                with system.open_input_file(f"{path}/ids-{shard:08d}.bin") as file:
                    yield from stretches(file, shard, keys, places[record], places[record + 1])

    def stretches(file, shard, keys, low, high) -> Iterator[pa.RecordBatch]:
        at = 0
        while at < len(low):
            to = at + 1
            while to < len(low) and low[to] == high[to - 1] and (high[to] - low[at]) * width <= STRETCH:
                to += 1
            data = np.frombuffer(file.read_at(int(high[to - 1] - low[at]) * width, int(low[at]) * width), store.dtype).astype("<u4")
            ends = np.concatenate([low[at:to], high[to - 1 : to]]) - low[at]
            yield pa.RecordBatch.from_arrays([
                keys.slice(at, to - at), pa.array(np.full(to - at, shard, np.int32)), pa.array(low[at:to]),
                pa.array([data[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())], schema=schema)
            at = to

    found = locate(keys, store, doc_id).repartition("shard").sortWithinPartitions("shard", "record").mapInArrow(
        read, "doc_id long, shard int, place long, ids binary")
    return found.join(shards_of(keys.sparkSession, store).select("shard", "start"), "shard").select(
        "doc_id", (F.col("start") + F.col("place")).alias("start"), "ids")


def shards_of(spark: SparkSession, store: TokenStore) -> DataFrame:
    """(shard, n_docs, n_ids, start) of a store."""
    return spark.read.schema("shard int, n_docs long, n_ids long, start long").parquet(f"{store.folder}/shards")
