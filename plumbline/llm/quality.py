"""A byte-level convolutional network in numpy that rates the quality of whole documents.

Bytes become small learned vectors; filters look at chunks of CHUNK bytes that begin every STRIDE bytes, so chunks overlap
and cover the document to its last byte. Each filter keeps its largest value over all chunks, and one logistic unit combines
them into a probability. Only the largest chunk per filter matters to a document's loss, so a gradient step touches few chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import as_bytes, per_batch, small_batches
from .fitting import bounded_sample, remainder
from .texts import chunks

CHUNK, STRIDE, WIDTH, FILTERS = 24, 8, 6, 24
#: Different labelled texts that the network is fitted on, per label.
FIT_TEXTS = 800
PAD = 256


@dataclass
class Network:
    vectors: np.ndarray  # 257 x WIDTH, the last for padding
    filters: np.ndarray  # CHUNK * WIDTH x FILTERS
    shift: np.ndarray
    output: np.ndarray
    constant: float

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.maximum(pooled, 0) @ self.output + self.constant, -30, 30)))


def _codes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes padded so that chunks end with the text, first place of each chunk, first chunk of each text)."""
    counts = np.array([max(1, -(-max(0, len(p) - CHUNK) // STRIDE) + 1) for p in parts])
    rooms = (counts - 1) * STRIDE + CHUNK
    begins = np.cumsum(rooms) - rooms
    codes = np.full(int(rooms.sum()), PAD, np.int16)
    for p, at in zip(parts, begins):
        codes[at : at + len(p)] = np.frombuffer(p, np.uint8)
    first = np.cumsum(counts) - counts
    places = np.repeat(begins, counts) + (np.arange(int(counts.sum())) - np.repeat(first, counts)) * STRIDE
    return codes, places, first


def _activations(net: Network, codes: np.ndarray, places: np.ndarray) -> np.ndarray:
    embedded = net.vectors[codes]
    windows = np.lib.stride_tricks.as_strided(embedded, (len(codes) - CHUNK + 1, CHUNK * WIDTH), (embedded.strides[0], embedded.strides[1]))
    return windows[places] @ net.filters + net.shift


def pooled(net: Network, parts: list[bytes]) -> np.ndarray:
    """The largest value of each filter over all chunks of each text; a long text goes through in pieces."""
    codes, places, first = _codes(parts)
    best = np.full((len(parts), len(net.shift)), -np.inf, np.float32)
    owner = np.repeat(np.arange(len(parts)), np.diff(np.append(first, len(places))))
    for begin in range(0, len(places), 16_384):
        some, of = places[begin : begin + 16_384], owner[begin : begin + 16_384]
        low = some[0]
        values = _activations(net, codes[low : some[-1] + CHUNK], some - low)
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        rows = of[starts]
        best[rows] = np.maximum(best[rows], np.maximum.reduceat(values, starts))
    return best


def train(sample: list[tuple[object, str]], epochs: int = 14, batch: int = 32, seed: int = 5) -> Network:
    """Adam on the mean log loss, both labels weighing alike; the same sample gives the same network."""
    draw = np.random.default_rng(seed)
    net = Network(draw.normal(0, 0.5, (257, WIDTH)).astype(np.float32),
                  draw.normal(0, (CHUNK * WIDTH) ** -0.5, (CHUNK * WIDTH, FILTERS)).astype(np.float32),
                  np.zeros(FILTERS, np.float32), draw.normal(0, 0.3, FILTERS).astype(np.float32), 0.0)
    texts = [t.encode("utf-8", "replace") for _, t in sample]
    y = np.array([label for label, _ in sample], np.float32)
    if len(set(y.tolist())) < 2:
        net.output[:] = 0
        net.constant = 0.0 if not len(y) else 3.0 * (2 * float(y[0]) - 1)
        return net
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    state = [np.zeros_like(p, dtype=np.float32) for p in (net.vectors, net.filters, net.shift, net.output, np.zeros(1))]
    square = [s.copy() for s in state]
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        order = draw.permutation(len(texts))
        for begin in range(0, len(order), batch):
            rows = order[begin : begin + batch]
            codes, places, first = _codes([texts[i] for i in rows])
            values = _activations(net, codes, places)
            ends = np.append(first[1:], len(places))
            top = np.array([a + values[a:b].argmax(0) for a, b in zip(first, ends)])
            best = values[top, np.arange(FILTERS)]
            hidden = np.maximum(best, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ net.output + net.constant, -30, 30)))
            wrong = ((p - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            inner = wrong[:, None] * net.output * (best > 0)
            seen = codes[places[top][:, :, None] + np.arange(CHUNK)]  # text x filter x byte
            chunk = net.vectors[seen].reshape(len(rows), FILTERS, -1)
            back = (inner[:, :, None] * net.filters.T).reshape(-1, WIDTH)
            at = seen.reshape(-1)
            vectors = np.stack([np.bincount(at, back[:, k], minlength=257) for k in range(WIDTH)], 1)
            grads = [vectors, np.einsum("tf,tfc->cf", inner, chunk), inner.sum(0), hidden.T @ wrong + 1e-4 * net.output,
                     np.array([wrong.sum()])]
            step += 1
            moves = []
            for k, g in enumerate(grads):
                g = g.astype(np.float32)
                state[k] = 0.9 * state[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                moves.append(rate * (state[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7))
            net.vectors -= moves[0]
            net.filters -= moves[1]
            net.shift -= moves[2]
            net.output -= moves[3]
            net.constant -= float(moves[4][0])
    return net


def score(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) per row, 0 to 1.

    Null and empty texts are one chunk of padding and get its score. Every byte of a text is seen, whatever its length. Rows that
    repeat a doc_id stay rows; other columns are ignored; an empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def rate(columns):
        found = [net.probability(pooled(net, parts)) for _, parts in chunks(as_bytes(columns["text"]))]
        return {"doc_id": columns["doc_id"], "score": np.concatenate(found).astype(np.float64)}

    return small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        per_batch(rate, schema), "doc_id long, score double")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", hold_out: tuple[int, int] | None = (3, 1)) -> Network:
    """A network fitted on labelled documents; `hold_out` (modulus, remainder of crc32 of the id) is left out."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label"))
    if hold_out:
        rows = rows.where(remainder(F.col("doc_id"), hold_out[0]) != hold_out[1])
    return train(bounded_sample(rows.where("label IN (0, 1)"), "label", FIT_TEXTS, docs))
