"""Language identification in two steps: the language family first, then one-versus-one linear machines within it.

A text is the square roots of the shares of its byte pairs and triples, hashed to a fixed number of places; letters count in lower
case, runs of anything else as one space.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import as_bytes, per_batch, small_batches
from .fitting import FIT_BYTES, bounded_sample, linear_svm, remainder
from .texts import LOWER, chunks, joined

#: Different texts per language that the machines are fitted on.
FIT_TEXTS = 400
PLACES = 4096
UNDETERMINED = "und"

# Language families by ISO 639-1 code; a language of no family here is one of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "turkic": ("tr", "az", "kk", "ky", "uz", "tk", "tt"),
    "uralic": ("fi", "et", "hu"),
    "indic": ("hi", "bn", "mr", "gu", "pa", "ne", "si", "ur"),
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

_PLAIN = LOWER.copy()
_PLAIN[[c for c in range(128) if not chr(c).isalpha()]] = 0x20


def family(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().split("-")[0], lang)


def features(parts: list[bytes]) -> np.ndarray:
    """One row of PLACES values of length 1 per text (0 for a text without letters)."""
    data, edges = joined(parts)
    data = _PLAIN[data]
    gap = data == 0x20
    keep = ~(gap & np.concatenate([[False], gap[:-1]]))
    keep[edges[1:-1]] = True
    owner = np.repeat(np.arange(len(parts)), np.diff(edges))[keep]
    data = data[keep].astype(np.uint32)
    counts = np.zeros(len(parts) * PLACES)
    for width in (2, 3):
        if len(data) < width:
            continue
        code = np.full(len(data) - width + 1, width, np.uint32)
        for k in range(width):
            code = code * np.uint32(0x01000193) ^ data[k : len(data) - width + 1 + k]
        place = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 12)).astype(np.int64)
        same = owner[: len(code)] == owner[width - 1 :]
        counts += np.bincount((owner[: len(code)] * PLACES + place)[same], minlength=len(counts))
    counts = counts.reshape(len(parts), PLACES)
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


@dataclass
class Machines:
    """Pairs of families, then pairs of languages of one family, with a machine each; positive means the first."""

    languages: list[str]
    families: list[str]
    pairs: list[tuple[str, str]]
    weights: np.ndarray  # pair x (PLACES + 1)
    scale: float = 3.0

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Winner of the pairwise votes among families, then among its languages; ties by the summed margins, then by name.

        The score is the smaller of the two steps' probabilities that the winner beats its closest rival.
        """
        margins = np.c_[x, np.ones(len(x), np.float32)] @ self.weights.T if len(self.pairs) else np.zeros((len(x), 0))

        def tournament(names: list[str], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            beats = np.zeros((len(rows), len(names), len(names)))
            for i, j in combinations(range(len(names)), 2):
                m = margins[rows, self.pairs.index((names[i], names[j]))]
                beats[:, i, j], beats[:, j, i] = m, -m
            votes = (beats > 0).sum(2) + np.tanh(beats.sum(2) / max(1, len(names))) / 4
            won = votes.argmax(1)
            rival = beats[np.arange(len(rows)), won]
            rival[np.arange(len(rows)), won] = np.inf
            closest = np.minimum(rival.min(1), 30 / self.scale) if len(names) > 1 else np.full(len(rows), 30 / self.scale)
            return won, 1 / (1 + np.exp(-self.scale * closest))

        everything = np.arange(len(x))
        group, sure = tournament(self.families, everything)
        out = np.empty(len(x), object)
        for k, name in enumerate(self.families):
            rows = everything[group == k]
            own = [lang for lang in self.languages if family(lang) == name]
            won, within = tournament(own, rows)
            out[rows] = [own[i] for i in won]
            sure[rows] = np.minimum(sure[rows], within)
        return out.tolist(), sure


def train(sample: list[tuple[object, str]]) -> Machines:
    """Machines from (language, text); only languages of the sample can be predicted."""
    languages = sorted({str(lang) for lang, _ in sample})
    families = sorted({family(lang) for lang in languages})
    x = np.concatenate([features(parts) for _, parts in chunks(t.encode("utf-8", "replace") for _, t in sample)]) if sample else np.zeros((0, PLACES))
    lang = np.array([str(v) for v, _ in sample], object)
    group = np.array([family(str(v)) for v, _ in sample], object)
    pairs, weights = [], []
    for names, of in [(families, group)] + [([v for v in languages if family(v) == f], lang) for f in families]:
        for a, b in combinations(names, 2):
            rows = (of == a) | (of == b)
            pairs.append((a, b))
            weights.append(linear_svm(x[rows], np.where(of[rows] == a, 1.0, -1.0).astype(np.float32)))
    return Machines(languages, families, pairs, np.array(weights, np.float32).reshape(len(pairs), PLACES + 1))


def has_letter(data: bytes) -> bool:
    return data.upper() != data.lower() or (not data.isascii() and any(c.isalpha() for c in data.decode("utf-8", "replace")))


def identify(docs: DataFrame, machines: Machines, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) per row.

    A null text, one without any letter, or no learned language give `und` with the score 0. Whole texts are counted, whatever their
    length. Rows that repeat a doc_id stay rows; other columns are ignored; an empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def predict(columns):
        langs, scores = [], []
        for _, parts in chunks(as_bytes(columns["text"])):
            found, sure = machines.predict(features(parts)) if machines.languages else ([UNDETERMINED] * len(parts), np.zeros(len(parts)))
            known = np.array([bool(machines.languages) and has_letter(p) for p in parts])
            langs += [f if k else UNDETERMINED for f, k in zip(found, known)]
            scores.append(np.where(known, sure, 0.0))
        return {"doc_id": columns["doc_id"], "lang_pred": langs, "score": np.concatenate(scores)}

    return small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        per_batch(predict, schema), "doc_id long, lang_pred string, score double")


def fit(docs: DataFrame, hold_out: tuple[int, int] | None = (4, 2)) -> Machines:
    """Machines fitted on documents with a language; `hold_out` (modulus, remainder of crc32 of the id) is left out."""
    rows = docs.select("doc_id", "text", "lang").where(F.octet_length("text") <= FIT_BYTES)
    if hold_out:
        rows = rows.where(remainder(F.col("doc_id"), hold_out[0]) != hold_out[1])
    return train(bounded_sample(rows, "lang", FIT_TEXTS))
