"""Token stores, periodic runs and collocations against plain loops, and the defined result of every odd case."""

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from compare import connect, difference
from plumbline.llm import collocations, oracle, periodic, registry, token_index

DOCS = "doc_id long, text string, lang string, hash string, row double"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SPEC = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
ODD = ["", "  ", "It's O'Neil's 42nd <|endoftext|> <|ENDOFTEXT|> a<|b", "\x1cx y z", "İ À ̀ ﬁ ẞ İ", "#" * 9,
       "\U0001f600 中文 ßÀÿ×÷", "a\x00b", "don't,'s !'s", "x" * 3000]


def frame(spark, rows):
    """Columns `hash` and `row` have names that operators use themselves."""
    return spark.createDataFrame([(i, t, lang, "h", 0.5) for i, t, lang in rows], DOCS)


# ------------------------------------------------------------------------------------------------------------ token store

@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aB'<|. \t\n\x1c3é́ßİ#,"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
def test_words_are_encoded_as_whole_texts_are(texts):
    plain = Tokenizer.from_str(SPEC)
    found = token_index.Encoder(SPEC).encode([t.encode() for t in texts])
    assert [np.frombuffer(b, "<u2").tolist() for b in found] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_index, "REMEMBERED", 5)
    encoder, plain = token_index.Encoder(SPEC), Tokenizer.from_str(SPEC)
    for texts in (["a b c d"], ["d e f a"], ["a b c d e f g h"], ODD):
        assert [np.frombuffer(b, "<u2").tolist() for b in encoder.encode([t.encode() for t in texts])] == [
            plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_tokenizers_see_whole_texts():
    spec = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    encoder = token_index.Encoder(spec)
    assert not encoder.by_word
    assert [np.frombuffer(b, encoder.dtype).tolist() for b in encoder.encode([t.encode() for t in ODD])] == [
        Tokenizer.from_str(spec).encode(t, add_special_tokens=False).ids for t in ODD]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1_000, 50_000])
def test_perfect_hash_is_minimal(n):
    keys = np.random.default_rng(n).choice(1 << 40, n, replace=False).astype(np.int64) - (1 << 39)
    prints = token_index.fingerprints(keys)
    built = token_index.PerfectHash.build(prints)
    assert sorted(built.slots(prints).tolist()) == list(range(n))


def test_index_file_knows_its_keys_and_no_others():
    keys = np.array([-5, 3, 3, 3, 1 << 62])
    where = np.array([[0, 0, 1], [0, 1, 4], [1, 0, 9], [2, 0, 1], [2, 1, 1]])
    index = token_index.Index.unpack(token_index.Index.build(keys, where, np.zeros((0, 3), np.int64)).pack())
    place, row = index.find(np.array([3, 7, -5, 0, 1 << 62]))
    assert [(p, index.segments[r].tolist()) for p, r in zip(place.tolist(), row)] == [
        (0, [0, 1, 4]), (0, [1, 0, 9]), (0, [2, 0, 1]), (2, [0, 0, 1]), (4, [2, 1, 1])]
    assert len(index.find(np.arange(100_000, 200_000))[0]) == 0
    with pytest.raises(ValueError):
        token_index.Index.unpack(b"12345678" * 8)


def wanted_digests(rows):
    plain, start, out = Tokenizer.from_str(SPEC), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def digests(spark, rows, keys=None):
    docs = frame(spark, [(i, t, "en") for i, t in rows])
    store = token_index.write_store(docs, SPEC)
    found = token_index.fetch(docs if keys is None else keys, store).collect()
    return [(r["doc_id"], r["start"], len(r["ids"]) // 4, zlib.crc32(bytes(r["ids"]))) for r in found], store


def test_store_reads_back_every_document(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), " ".join(f"Word{x}" for x in rng.integers(0, 300, 20))) for i in rng.permutation(400) - 30]
    rows += [(1_000 + k, t) for k, t in enumerate([None, *ODD])] + [(5_000, "long text, " * 30_000)]
    found, store = digests(spark, rows)
    assert sorted(found) == sorted(wanted_digests(rows))
    shards = sorted(token_index.shards_of(spark, store).collect())
    assert sum(s["n_docs"] for s in shards) == len(rows) and len(shards) > 1
    some = spark.createDataFrame([(0,), (0,), (77_777,), (5_000,), (-30,)], "doc_id long")
    assert sorted(r["doc_id"] for r in token_index.fetch(some, store).collect()) == [-30, 0, 5_000]


def test_repeated_and_null_ids_are_all_found(spark):
    rows = [(7, f"text {k % 50}") for k in range(300)] + [(None, "one"), (None, "two"), (None, None), (0, "zero"), (8, "x"), (8, "x")]
    found, _ = digests(spark, rows)
    wanted = wanted_digests(rows)
    assert Counter((i, n, c) for i, _, n, c in found) == Counter((i, n, c) for i, _, n, c in wanted)
    # documents lie one after the other in the order of their ids
    ordered = sorted(found, key=lambda r: r[1])
    assert [r[1] for r in ordered] == np.concatenate([[0], np.cumsum([r[2] for r in ordered])[:-1]]).tolist()
    assert [r[0] for r in ordered] == [r[0] for r in wanted]


def test_empty_table_has_an_empty_store(spark):
    assert digests(spark, [])[0] == []


def test_token_query_equals_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    found = [tuple(r) for r in registry.op11_token_index(spark, "/root/testdata/sf0.001").select(
        "doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(found) == wanted_digests([(r["doc_id"], r["text"]) for r in docs])


# ---------------------------------------------------------------------------------------------------------- periodic runs

def plain_runs(words):
    """The DP over every lag, word by word; then runs with a smaller period go."""
    n, found = len(words), set()
    for q in range(1, n // 4 + 1):
        length = 0
        for i in range(q, n + 1):
            if i < n and words[i] == words[i - q]:
                length += 1
                continue
            if length and length + q >= max(6, 4 * q):
                start = i - length - q
                stretch = words[start:i]
                if not any(all(stretch[k] == stretch[k - p] for k in range(p, len(stretch))) for p in range(1, q)):
                    found.add((start, i - start, q))
            length = 0
    return sorted(found)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 9)), max_size=5), max_size=4))
def test_runs_match_the_plain_dp(spec):
    texts = [[w for unit, times in text for w in unit * times] for text in spec]
    words = np.array([w for t in texts for w in t], np.int64)
    own = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    begins = np.cumsum([0, *map(len, texts)])
    wanted = [(int(s + begins[k]), length, q) for k, t in enumerate(texts) for s, length, q in plain_runs(t)]
    assert [tuple(r) for r in periodic.runs_of(words, own).tolist()] == sorted(wanted, key=lambda r: (r[0], r[2]))


def test_long_texts_of_one_word_stay_cheap():
    assert periodic.runs_of(np.zeros(1_000_000, np.int64), np.zeros(1_000_000, np.int64)).tolist() == [[0, 1_000_000, 1]]
    period = np.random.default_rng(1).permutation(100_000)
    assert periodic.runs_of(np.tile(period, 5), np.zeros(500_000, np.int64)).tolist() == [[0, 500_000, 100_000]]


def plain_row(doc_id, text, loop=True):
    words = WORD.findall((text or "").encode())
    n = len(words)
    if loop and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0 and n:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    told = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_run_query_equals_the_plain_dp(spark, tmp_path):
    docs = [(r["doc_id"], " ".join(r["text"].split()[:400]) if r["text"] else None) for r in spark.read.parquet(
        "/root/testdata/sf0.001/documents.parquet").collect()][:120]
    docs += [(10_000 + k, " ".join("ab cd ef".split()[: k % 3 + 1] * k) + "\x0b tail   x") for k in range(40)]
    docs += [(None, "z " * 9), (None, "z " * 9), (3, None), (4, ""), (5, " \n"), (6, "a b " * 3 + "a b c"), (6, "a b " * 3 + "a b c")]
    frame(spark, [(i, t, "en") for i, t in docs]).write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in registry.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(found, key=repr) == sorted((plain_row(*d) for d in docs), key=repr)


def test_no_rows_no_runs(spark):
    assert periodic.find_runs(frame(spark, [])).collect() == []
    kept = periodic.find_runs(frame(spark, [(1, "b a a a a a a b", "en")])).collect()[0]
    assert kept["collapsed"] == "b a b" and [tuple(r) for r in kept["runs"]] == [(1, 6, 1)]


# ----------------------------------------------------------------------------------------------------------- collocations

def plain_counts(rows, longest=3):
    counts = Counter()
    for lang, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, longest + 1):
                counts.update((lang or "und", " ".join(words[i:i + size])) for i in range(len(words) - size + 1))
    return counts


def some_texts():
    rng = np.random.default_rng(5)
    texts = [(["en", "fr", None][k % 3], " ".join(rng.choice(list("abcdeF"), 30)) + ("." if k % 2 else "\n") + "Hot pair\tHOT pair, x" * 3)
             for k in range(60)]
    return texts + [("en", None), ("en", ""), (None, " ,, "), ("und", "hot pair " * 40), ("de", "once only here"), ("en", " \x1c \x00 é É")]


def test_phrases_are_counted_whole(spark):
    rows = some_texts()
    found = collocations.count_phrases(frame(spark, [(k, t, lang) for k, (lang, t) in enumerate(rows)])).collect()
    counts = plain_counts(rows)
    assert {(r["lang"], r["phrase"]): r["f"] for r in found if r["phrase"]} == {k: f for k, f in counts.items() if f >= 10}
    assert all(r["size"] == len(r["phrase"].split(" ")) for r in found if r["phrase"])
    words = Counter()
    for r in found:
        words[r["lang"]] += r["f"] if r["phrase"] is None else 0
    assert +words == Counter({lang: sum(f for (own, p), f in counts.items() if own == lang and " " not in p) for lang in words})


def test_blocks_and_buckets_change_nothing(spark, monkeypatch):
    docs = frame(spark, [(k, t, lang) for k, (lang, t) in enumerate(some_texts())])
    wanted = sorted(map(tuple, collocations.collocations(docs, least=4, longest=4, top=50).collect()))
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 100)
    monkeypatch.setattr(collocations, "BUCKET_BYTES", 200)
    assert wanted and wanted == sorted(map(tuple, collocations.collocations(docs, least=4, longest=4, top=50).collect()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(0, 4), st.integers(0, 3), st.integers(1, 5)), max_size=60), st.integers(1, 8))
def test_quicksort_counts_as_a_dictionary(rows, least):
    columns = [np.array([r[c] for r in rows], np.int32) for c in range(3)]
    counts = Counter()
    for r in rows:
        counts[r[:3]] += r[3]
    at, total = collocations.phrases_by_quicksort(columns, np.array([r[3] for r in rows], float), least)
    assert {tuple(rows[i][:3]): f for i, f in zip(at.tolist(), total.tolist())} == {k: f for k, f in counts.items() if f >= least}


def test_collocations_equal_sql_on_odd_rows(spark, tmp_path):
    docs = frame(spark, [(k, t, lang) for k, (lang, t) in enumerate(some_texts())])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = connect("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert difference(registry.op13_collocations(spark, str(tmp_path)), con, oracle.OP13) is None
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark, monkeypatch):
    a, l, r = 3_000_000_000_001, 3_000_000_000_003, 3_000_000_000_007
    rows = [("en", "x y", 2, a), ("en", "x", 1, l), ("en", "y", 1, r), ("en", None, 0, 9 * 10 ** 12)]
    told = spark.createDataFrame(rows, "lang string, phrase string, size int, f long")
    monkeypatch.setattr(collocations, "count_phrases", lambda *_: told)
    assert collocations.collocations(told).collect()[0]["score"] == 1_000_000 * a * a // (l * r)
