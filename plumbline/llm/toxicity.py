"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, exception phrases, normalised by length.

Folding maps look-alike letters of other scripts and digits that stand for letters to plain letters, one character for one, so
places in the folded text are places in the text. The lexicon and its weights are learned from labelled documents, or given.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import per_batch, small_batches
from .fitting import bounded_sample, logistic, remainder

#: Different labelled texts that the lexicon is learned from, per label.
FIT_TEXTS = 1_500
#: Words that a learned lexicon holds at most: those of the largest weight times use.
LEXICON_WORDS = 2_000

# Letters of Cyrillic and Greek that look like Latin ones, and digits and signs that stand for letters.
LOOK_ALIKES = dict(zip("аеіїоорсухѕԁһјкмтвнΑΒΕΖΗΙΚΜΝΟΡΤΥΧαοιρνκτυ", "aeiioopcyxsdhjkmtbhabezhikmnoptyxaoipvktu"))
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}

# Letters are folded before they are lower-cased, so capitals are in the map as well; Greek ones that look unlike their small
# letter have their own entry.
_FOLD = {ord(a): b for a, b in ({a.upper(): b for a, b in LOOK_ALIKES.items()} | LOOK_ALIKES | LEET).items()} | {ord("İ"): "i"} | {
    c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_FOLD_ASCII = bytes(ord(LEET.get(chr(c).lower(), chr(c).lower())) for c in range(128)) + bytes(range(128, 256))
_TOKEN = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower case, look-alikes and digit substitutions folded; as long as the text."""
    if text.isascii():
        return text.encode().translate(_FOLD_ASCII).decode()
    folded = text.translate(_FOLD).lower()
    return folded if len(folded) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text.translate(_FOLD))


@dataclass
class Lexicon:
    """Words with weights, phrases in which they do not count, and the two factors and the constant of the score."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    score: tuple[float, float, float] = (0.5, 0.5, -2.0)

    def automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for word, weight in self.weights.items():
            machine.add_word(word, (len(word), weight))
        for phrase in self.exceptions:
            machine.add_word(phrase, (len(phrase), None))
        if len(machine):
            machine.make_automaton()
        return machine


def matches(machine, text: str) -> tuple[float, int, str]:
    """(sum of weights, number of words that count, folded text): whole words outside exception phrases."""
    folded = fold(text)
    if not len(machine):
        return 0.0, 0, folded
    hits, excused, end = [], [], len(folded)
    for last, (length, weight) in machine.iter(folded):
        first = last - length + 1
        if (first and folded[first - 1].isalpha()) or (last + 1 < end and folded[last + 1].isalpha()):
            continue
        if weight is None:
            excused.append((first, last))
        elif any(c.isalpha() for c in text[first : last + 1]):
            hits.append((first, last, weight))
    if excused:
        # the furthest end of all phrases that begin at or before a place
        excused.sort()
        begins = [a for a, _ in excused]
        ends = list(accumulate((b for _, b in excused), max))
        hits = [h for h in hits if not ((at := bisect_right(begins, h[0])) and h[1] <= ends[at - 1])]
    return sum(w for _, _, w in hits), len(hits), folded


def _features(machine, text: str) -> tuple[float, float, int]:
    """The sum of weights on a log scale, the same per hundred words, and the number of matches."""
    total, n, folded = matches(machine, text)
    return (math.log1p(total), math.log1p(100 * total / max(1, len(folded.split()))), n) if n else (0.0, 0.0, 0)


def _score(machine, lexicon: Lexicon, text: str) -> tuple[float, int]:
    a, b, n = _features(machine, text)
    z = lexicon.score[0] * a + lexicon.score[1] * b + lexicon.score[2]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), n


def learn(sample: list[tuple[object, str]]) -> Lexicon:
    """A lexicon from (label 0 or 1, text).

    A word counts once per different pair of neighbours, so that copies of one text do not make its rare words look toxic. A
    neighbour pair of a lexicon word that is as common in clean texts becomes an exception phrase.
    """
    used = {0: defaultdict(set), 1: defaultdict(set)}
    docs = Counter(label for label, _ in sample)
    if not docs[1]:
        return Lexicon({}, [], (0.0, 0.0, -3.0))
    found = {0: Counter(), 1: Counter()}
    for _, text in (s for s in sample if s[0] == 1):
        found[1].update(set(_TOKEN.findall(fold(text))))
    least = max(3, docs[1] // 200)
    found[1] = Counter({word: n for word, n in found[1].items() if n >= least})
    for _, text in (s for s in sample if s[0] == 0):
        found[0].update(found[1].keys() & set(_TOKEN.findall(fold(text))))
    wanted = {}
    for word, n in found[1].items():
        gain = math.log((n + 0.5) / (docs[1] + 1)) - math.log((found[0][word] + 0.5) / (docs[0] + 1))
        if n >= least and gain >= 1.5 and len(word) > 1:
            wanted[word] = gain
    for label, text in sample:
        words = ["", *_TOKEN.findall(fold(text)), ""]
        for at, word in enumerate(words):
            if word in wanted:
                used[label][word].add((words[at - 1], words[at + 1]))
    weights = {w: g for w, g in wanted.items() if len(used[1][w]) >= max(least, 0.5 * found[1][w])}
    best = sorted(weights, key=lambda w: (-weights[w] * len(used[1][w]), w))[:LEXICON_WORDS]
    phrases = {0: Counter(), 1: Counter()}
    for label in (0, 1):
        for word in best:
            for before, after in used[label][word]:
                phrases[label].update({f"{before} {word}", f"{word} {after}"})
    exceptions = sorted(p for p, n in phrases[0].items() if n >= 2 and n > 2 * phrases[1][p] and " " in p.strip())
    lexicon = Lexicon({w: round(weights[w], 4) for w in sorted(best)}, exceptions)
    machine = lexicon.automaton()
    x = np.array([_features(machine, text)[:2] for _, text in sample])
    y = np.array([label for label, _ in sample], float)
    lexicon.score = tuple(float(v) for v in logistic(x, y))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, n_matches) per row: score is 0 to 1.

    Null, empty and wordless texts have no match and get the lowest score; a text is matched whole, whatever its length.
    Rows that repeat a doc_id stay rows; other columns are ignored; an empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_matches", pa.int64())])
    made = []

    def rate(columns):
        if not made:
            made.append(lexicon.automaton())
        scores, counts = [], []
        for value in columns["text"].to_pylist():
            rating, n = _score(made[0], lexicon, value or "")
            scores.append(rating)
            counts.append(n)
        return {"doc_id": columns["doc_id"], "score": scores, "n_matches": counts}

    return small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        per_batch(rate, schema), "doc_id long, score double, n_matches long")


def keep_below(docs: DataFrame, lexicon: Lexicon, limit: float, text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns as they are, whose text scores below the limit; each text is read once, nothing is joined."""
    made = []

    def select(batches):
        for batch in batches:
            if not made:
                made.append(lexicon.automaton())
            texts = batch.column(batch.schema.names.index(text)).to_pylist()
            yield batch.filter(pa.array([_score(made[0], lexicon, t or "")[0] < limit for t in texts], pa.bool_()))

    return small_batches(docs).mapInArrow(select, docs.schema)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", hold_out: tuple[int, int] | None = (3, 1)) -> Lexicon:
    """A lexicon learned from labelled documents; `hold_out` (modulus, remainder of crc32 of the id) is left out."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label"))
    if hold_out:
        rows = rows.where(remainder(F.col("doc_id"), hold_out[0]) != hold_out[1])
    return learn(bounded_sample(rows.where("label IN (0, 1)"), "label", FIT_TEXTS, docs))
