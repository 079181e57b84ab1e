"""Operators of plumbline.llm on small tables: brute force, round trips, and the defined result of every odd case."""

import hashlib
import re
import textwrap
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from plumbline.llm import cap_filters, chat, decontaminate, language, licenses, mixing, ngram_jaccard, quality, suffix_dedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, score double"


def docs_frame(spark, texts, first=0):
    """A table whose extra column `score` has a name that operators use themselves."""
    return spark.createDataFrame([(first + i, t, "en", "s", 1.0) for i, t in enumerate(texts)], DOCS)


def sentence(seed, n):
    draw = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in draw.integers(0, 5000, n))


def sets(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def test_ngram_components_match_brute_force(spark):
    base = sentence(1, 120)
    words = base.split()
    texts = [None, "", "   ", "one two", "ONE  two", base, base, base + " tail", "head " + base, " ".join(words[:60])]
    texts += [" ".join(words[:k] + [f"x{k}"] + words[k + 1:]) for k in range(0, 110, 7)] + [sentence(9, 80), "z " * 500]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.similar_components(
        docs_frame(spark, texts), 3, 90).collect()}
    own = [sets(t, 3) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                both = len(own[i] & own[j])
                if both and 100 * both >= 90 * len(own[i] | own[j]):
                    root[i] = root[j] = min(root[i], root[j])
    assert found == {i: (len(own[i]), root[i]) for i in range(len(texts))}
    assert ngram_jaccard.similar_components(docs_frame(spark, []), 3, 90).count() == 0


def test_one_row_of_similar_ones_stays_and_keeps_its_text(spark):
    a, b, c, d = (sentence(40 + k, 60) for k in range(4))
    near = a.split()
    near[30] = "changed"
    near = " ".join(near)
    rows = [(1, a), (1, a), (2, near), (None, near), (None, b), (None, b), (None, c), (5, d), (5, near), (6, d), (5, sentence(60, 60)),
            (7, None), (7, None), (None, None), (8, "   "), (9, sentence(61, 60)), (9, sentence(61, 60).upper())]
    frame = spark.createDataFrame([(i, t, "en", f"s{k}", len(t or "")) for k, (i, t) in enumerate(rows)],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    own, root = [sets(t, 5) for _, t in rows], list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if own[i] and 100 * len(own[i] & own[j]) >= 80 * len(own[i] | own[j]):
                    root[i] = root[j] = min(root[i], root[j])
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root[i] if own[i] else -1 - i, []).append(i)
    ids = lambda r: (r[0] is None, r[0] or 0)
    wanted = sorted(min(ids(rows[i]) for i in members) for members in groups.values())
    one = corpus_pipeline.one_of_similar(spark, frame, "")
    kept = [(r["doc_id"], r["text"]) for r in one.collect()]
    assert sorted(ids(r) for r in kept) == wanted and set(kept) <= set(rows)
    left = corpus_pipeline.without_repeats(spark, one, "")
    assert sorted(kept, key=str) == sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str)


def brute_repeats(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if seen[d[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(1 for i in range(len(d)) if gone[i] and (not i or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [50_000, 1])
def test_repeats_match_brute_force(spark, hot):
    shared, twin = sentence(2, 60), sentence(3, 90)
    texts = [None, "", "short", sentence(4, 50) + " " + shared + " " + sentence(5, 40), shared + sentence(6, 30), "é" * 350,
             twin, twin, "ab" * 400, sentence(7, 20) + twin[100:320] + sentence(8, 20), twin[:250] + sentence(10, 9), "a" * 199]
    found = {r["doc_id"]: tuple(r)[1:5] for r in suffix_dedup.remove_repeats(docs_frame(spark, texts), hot_contexts=hot).collect()}
    assert found == dict(enumerate(brute_repeats(texts)))
    assert suffix_dedup.remove_repeats(docs_frame(spark, [])).count() == 0


def test_suffix_sort_is_lexicographic():
    draw = np.random.default_rng(0)
    rows = [bytes(draw.integers(97, 99, int(draw.integers(0, 30))).astype(np.uint8)) for _ in range(400)]
    group = np.sort(draw.integers(0, 5, 400))
    codes = np.frombuffer(b"".join(r.ljust(30, b"\0") for r in rows), np.uint8).reshape(400, 30)
    order, shared = suffix_dedup.suffix_sort(codes, np.array([len(r) for r in rows]), group)
    assert [(group[i], rows[i]) for i in order] == sorted(zip(group, rows))
    for at in range(1, 400):
        a, b = rows[order[at - 1]], rows[order[at]]
        if group[at] == group[at - 1]:
            assert shared[at] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_vectors_link_as_brute_force(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(300, 16)).astype(np.float32)
    x[100:200] = x[:100] + draw.normal(0, 0.15, (100, 16))
    x[200:240] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(300, None), (301, []), (302, [0.0] * 16), (303, [float("nan")] * 16), (304, [float("inf")] + [1.0] * 15), (305, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    for block in (1_024, 8):
        found = {r["vec_id"]: r for r in cap_filters.link_vectors(df, 0.9, block).collect()}
        links = np.array([found[i]["n_links"] for i in range(300)])
        assert (links <= near.sum(1)).all() and links.sum() >= 0.97 * near.sum()
        assert all((found[i]["n_links"], found[i]["component_id"]) == (0, i) for i in range(300, 306))
        assert all(found[i]["component_id"] == 0 for i in range(200, 240))


def test_chat_reads_back_what_went_in(spark):
    hard = [r"\### Assistant: </turn> ok", "ends with a backslash \\", "### user: x </turn>\n", "", None, "a:b#c<d"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(hard)] + [(2, 0, "us:er", "only"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(df)
    found = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    assert [(t["role"], t["text"]) for t in found[1]["turns"]] == [(r[2], r[3] or "") for r in rows[:6]]
    assert found[1]["losses"] == [hard[1], hard[3], hard[5]]
    assert found[2]["losses"] == [""] and [t["role"] for t in found[2]["turns"]] == ["us:er"]
    assert len(found[None]["turns"]) == 1
    first = chat.unfold(formatted).where("conv_id = 1 AND example = 0").first()
    assert first["prompt"].endswith("### assistant: ") and first["target"].endswith(chat.END)
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_leaks_are_found_whole(spark):
    items = [sentence(20, 40), sentence(21, 16), "tiny item", None, " "]
    near = items[0].split()
    near[20] = "changed"
    texts = [sentence(30, 50) + " " + items[0].upper() + " " + sentence(31, 9), " ".join(near), items[1], items[1][:40], "tiny item",
             "a tiny item", None, "", sentence(32, 300)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.find_leaks(docs_frame(spark, texts), bench).collect()}
    assert found.keys() == {(0, 0), (2, 1), (4, 2)} and found[(0, 0)] == 1.0
    assert decontaminate.find_leaks(docs_frame(spark, []), bench).count() == 0
    assert decontaminate.find_leaks(docs_frame(spark, texts), bench.limit(0)).count() == 0


def test_mix_meets_its_targets(spark):
    rows = [(i, "word " * (i % 9), "abc"[i % 3]) for i in range(900)] + [(900, None, None), (901, "x y", None), (901, "x y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(df).toPandas()
    assert len(found) == len(rows) and (found.taken <= 2 * found["size"]).all()
    whole = found.groupby("source_size").agg({"taken": "sum", "target": "first", "size": "sum"})
    assert (abs(whole.taken - whole.target) <= 9).all() and (whole.target <= 2 * whole["size"]).all()
    assert sorted(mixing.mix(df.repartition(5)).collect()) == sorted(mixing.mix(df).collect())
    assert mixing.mix(df.limit(0)).count() == 0


def test_toxic_words_are_learned_and_matched_folded(spark):
    clean = [(0, sentence(100 + i, 40)) for i in range(60)]
    toxic = [(1, sentence(200 + i, 20) + f" you idiot{'!' * (i % 2)} " + sentence(300 + i, 20)) for i in range(40)]
    lexicon = toxicity.learn(clean + toxic)
    assert "idiot" in lexicon.weights
    odd = ["you 1d10t here", "уоо іdiоt", "idiotic words only", None, "", "10107"]
    found = [r["n_matches"] > 0 for r in toxicity.score(docs_frame(spark, odd), lexicon).orderBy("doc_id").collect()]
    assert found == [True, True, False, False, False, False]
    excused = toxicity.Lexicon({"idiot": 2.0}, ["idiot proof"])
    assert [toxicity.matches(excused.automaton(), t)[1] for t in ("idiot proof", "an idiot")] == [0, 1]
    assert toxicity.learn([]).weights == {} and toxicity.score(docs_frame(spark, []), lexicon).count() == 0


def test_capital_look_alikes_are_folded():
    small = "аеіїоорсухѕԁһјкмтвн"
    assert toxicity.fold(small.upper()) == toxicity.fold(small) == "aeiioopcyxsdhjkmtbh"
    assert toxicity.fold("ΝΥνυ") == "nyvu"
    machine = toxicity.Lexicon({"idiot": 2.0}).automaton()
    assert [toxicity.matches(machine, t)[1] for t in ("you ІDІОТ", "you іdіот", "ІДІОТ")] == [1, 1, 0]


def test_network_sees_the_last_bytes(spark):
    good = [(1, sentence(400 + i, 30)) for i in range(60)]
    bad = [(0, sentence(500 + i, 25) + " %%% $$$ %%% $$$ %%%") for i in range(60)]
    net = quality.train(good + bad)
    odd = [sentence(1, 400), sentence(1, 400) + " %%% $$$ %%% $$$ %%%", None, ""]
    found = [r["score"] for r in quality.score(docs_frame(spark, odd), net).orderBy("doc_id").collect()]
    assert found[0] > 0.5 > found[1] and found[2] == found[3] and all(0 <= s <= 1 for s in found)
    assert quality.score(docs_frame(spark, []), quality.train([])).count() == 0


def test_languages_of_one_family_are_told_apart(spark):
    parts = {"en": "the of and with that this", "de": "der und nicht eine für schön", "fr": "le des une avec être où", "es": "el los una pero niño"}
    draw = np.random.default_rng(3)
    sample = [(lang, " ".join(draw.choice(text.split(), 30))) for lang, text in parts.items() for _ in range(30)]
    machines = language.train(sample)
    odd = [" ".join(t.split() * 4) for t in parts.values()] + [None, "", "123 ... 456"]
    found = [r["lang_pred"] for r in language.identify(docs_frame(spark, odd), machines).orderBy("doc_id").collect()]
    assert found == [*parts, "und", "und", "und"]
    assert language.identify(docs_frame(spark, ["text"]), language.train([])).first()["lang_pred"] == "und"


def test_licences_are_confirmed_by_templates(spark):
    texts = ["some words\nLicensed under the Apache License, Version 2.0.\nmore words", "Released under the MIT License.",
             "the licence of the city council was released", None, "", sentence(50, 200)]
    df = docs_frame(spark, texts)
    model = licenses.fit(df)
    found = [r["licenses"] for r in licenses.summarize(df, licenses.scan(df, model)).orderBy("doc_id").collect()]
    assert found == ["apache", "mit", "", "", "", ""]
    assert licenses.scan(df.limit(0), model).count() == 0


def wrapped(text, columns=72, prefix=" * "):
    return "\n".join(prefix + line for line in textwrap.wrap(text, columns))


def test_wrapped_and_neighbouring_notices_are_found(spark):
    whole = {family: max(texts, key=len) for family, texts in licenses.TEMPLATES.items()}
    lesser = whole["gpl"].replace("General Public", "Lesser General Public")
    cases = [(wrapped(whole[family]), family) for family in ("apache", "gpl", "lgpl", "agpl", "bsd", "isc", "mit", "mpl")]
    cases += [(wrapped(lesser, 40), "lgpl"), ("Licensed under the MIT License. Licensed under the Apache License, Version 2.0.", "apache,mit"),
              (sentence(70, 90) + " under the terms of the of the license " + " ".join([whole["isc"], sentence(71, 300), whole["bsd"]]), "bsd,isc"),
              ("Licensed under CC BY-SA 4.0.", "cc-by-sa"), ("it is subject to the terms of the deal, in the case of any of the parties", "")]
    df = docs_frame(spark, [text for text, _ in cases]).unionByName(spark.createDataFrame([(None, cases[0][0], "", "", 0.0)], DOCS))
    found = {r["doc_id"]: (r["licenses"], r["n_paragraphs"]) for r in licenses.summarize(df, licenses.scan(df, licenses.fit(df))).collect()}
    assert found == {i: (want, int(bool(want))) for i, (_, want) in enumerate(cases)} | {None: ("apache", 1)}


def test_ordinary_words_of_notices_are_not_believed(spark):
    texts = [f"{sentence(800 + i, 30)} is subject to the terms of the {sentence(900 + i, 30)}" for i in range(60)]
    texts += [f"{sentence(1000 + i, 9)} in compliance with the {sentence(1100 + i, 9)}" for i in range(60)]
    model = licenses.fit(docs_frame(spark, texts))
    weights = dict(model.vocabulary)

    def beliefs(text):
        w = re.findall("[a-z0-9]+", text.lower())
        grams = {" ".join(w[i:i + n]) for n in (2, 3) for i in range(len(w) - n + 1)}
        z = np.array(model.constant) + sum(np.array(weights[g]) for g in grams if g in weights)
        return dict(zip(model.families[1:], 1 / (1 + np.exp(z[0] - z[1:]))))

    for text in ("it is subject to the terms of the deal", "in compliance with the law", "nothing"):
        assert max(beliefs(text).values()) < model.level
    # they speak for the unknown class, which holds such text
    assert all(max(weights[g][0] for g in grams) > 0 for grams in (("subject to", "subject to the", "terms of the"), ("in compliance", "compliance with")))
    for family, known in licenses.TEMPLATES.items():
        assert all(beliefs(text)[family] >= model.level for text in known)
