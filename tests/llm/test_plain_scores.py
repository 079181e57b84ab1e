"""Scores of the classifiers recomputed by plain loops on small fitted models."""

import math
from itertools import combinations

import numpy as np
import pytest

from plumbline.llm import language, quality, toxicity

TEXTS = [None, "", "   ", "a", "The cat sat on the mat. " * 9, "xq zzv qqx " * 30, "Straße über Öl, café ñandú", "9 8 7 - - -", "été là " * 200,
         "x" * 5_000 + " end", "the the\n\n\nTHE  the", "tail bytes !!!? " * 3 + "é"]


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "en", 0.1, "p") for k, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, score double, lang_pred string")


def test_quality_is_the_network_computed_chunk_by_chunk(spark):
    rng = np.random.default_rng(2)
    words = [("good words here and there ", 1), ("qzx#@ 00 ", 0)]
    sample = [(label, text * int(rng.integers(1, 12)) + str(k)) for k in range(30) for text, label in words]
    net = quality.train(sample, epochs=4)
    found = {r["doc_id"]: r["score"] for r in quality.score(frame(spark, TEXTS + TEXTS[4:5]), net).collect()}

    def plain(text):
        data = list((text or "").encode())
        n = max(1, -(-max(0, len(data) - quality.CHUNK) // quality.STRIDE) + 1)
        best = [-math.inf] * quality.FILTERS
        for c in range(n):
            chunk = data[c * quality.STRIDE:c * quality.STRIDE + quality.CHUNK]
            chunk += [quality.PAD] * (quality.CHUNK - len(chunk))
            flat = np.concatenate([net.vectors[b] for b in chunk]).astype(float)
            for f in range(quality.FILTERS):
                best[f] = max(best[f], float(flat @ net.filters[:, f].astype(float)) + float(net.shift[f]))
        z = sum(max(b, 0.0) * float(w) for b, w in zip(best, net.output)) + net.constant
        return 1 / (1 + math.exp(-max(-30, min(30, z))))

    assert all(abs(found[k] - plain(t)) < 1e-4 for k, t in enumerate(TEXTS)) and found[len(TEXTS)] == found[4]


def plain_features(text):
    data = [language._PLAIN[b] for b in text.encode()]
    kept = [int(b) for k, b in enumerate(data) if not (b == 0x20 and k and data[k - 1] == 0x20)]
    # a text's closing separator counts as a space, as between the texts of a batch
    kept = kept if kept and kept[-1] == 0x20 else kept + [0x20]
    x = np.zeros(language.PLACES)
    for width in (2, 3):
        for k in range(len(kept) - width + 1):
            code = width
            for b in kept[k:k + width]:
                code = (code * 0x01000193 & 0xFFFFFFFF) ^ b
            x[(code * 0x9E3779B1 & 0xFFFFFFFF) >> 20] += 1
    return np.sqrt(x / max(1, x.sum()))


def test_language_is_the_tournament_computed_pair_by_pair(spark):
    told = {"en": "the thing of and that is with", "de": "der die das und nicht mit ist", "fr": "le la les et pas avec est", "es": "el los las y no con es"}
    rng = np.random.default_rng(1)
    sample = [(lang, " ".join(rng.choice(words.split(), 30))) for lang, words in told.items() for _ in range(12)]
    machines = language.train(sample)
    texts = TEXTS + list(told.values())
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(frame(spark, texts), machines).collect()}

    def won(names, x):
        votes, margins = {n: 0 for n in names}, {n: 0.0 for n in names}
        beats = {}
        for a, b in combinations(names, 2):
            w = machines.weights[machines.pairs.index((a, b))].astype(float)
            m = float(x @ w[:-1] + w[-1])
            beats[a, b], beats[b, a] = m, -m
        total = {n: sum(v > 0 for (a, _), v in beats.items() if a == n) + math.tanh(
            sum(v for (a, _), v in beats.items() if a == n) / max(1, len(names))) / 4 for n in names}
        best = max(names, key=lambda n: total[n])
        rivals = [v for (a, _), v in beats.items() if a == best]
        return best, 1 / (1 + math.exp(-machines.scale * min([*rivals, 30 / machines.scale])))

    for k, text in enumerate(texts):
        if not any(c.isalpha() for c in text or ""):
            assert found[k] == ("und", 0.0)
            continue
        x = plain_features(text)
        family, sure = won(machines.families, x)
        lang, within = won([v for v in machines.languages if language.family(v) == family], x)
        assert found[k][0] == lang and abs(found[k][1] - min(sure, within)) < 1e-3, text[:30]
    assert [found[len(TEXTS) + k][0] for k in range(4)] == list(told)


@pytest.mark.parametrize("repeat", [1, 300])
def test_toxicity_is_the_sum_over_plain_searches(spark, repeat):
    lexicon = toxicity.Lexicon({"vile": 2.0, "scum": 3.0, "vi": 0.5}, ["not vile", "scum line"], (0.8, 0.6, -2.5))
    texts = [t * repeat for t in ("vile scum ", "n0t v1le but VILE ", "scum line, scum ", "evile viles vi ", "ѕсum аnd vіlе ", "plain words ")] + TEXTS

    def plain(text):
        folded, hits, excused = toxicity.fold(text), [], []
        for word, weight in [*lexicon.weights.items(), *((p, None) for p in lexicon.exceptions)]:
            at = folded.find(word)
            while at >= 0:
                end = at + len(word)
                if not (at and folded[at - 1].isalpha()) and not (end < len(folded) and folded[end].isalpha()):
                    (excused if weight is None else hits).append((at, end, weight))
                at = folded.find(word, at + 1)
        kept = [w for a, b, w in hits if not any(x <= a and b <= y for x, y, _ in excused) and any(c.isalpha() for c in text[a:b])]
        total = sum(kept)
        a, b = (math.log1p(total), math.log1p(100 * total / max(1, len(folded.split())))) if kept else (0.0, 0.0)
        return 1 / (1 + math.exp(-(0.8 * a + 0.6 * b - 2.5))), len(kept)

    for r in toxicity.score(frame(spark, texts), lexicon).collect():
        score, n = plain(texts[r["doc_id"]] or "")
        assert abs(r["score"] - score) < 1e-9 and r["n_matches"] == n, texts[r["doc_id"]][:40]
