"""Learned operators: held-out accuracy, forward sums and N-best searches against brute force, defined results for odd rows."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from axiomill.llm import language_id, nbest_pieces, quality, toxicity
from axiomill.llm.common import Interner, crc_mod

P = pytest.importorskip("public_tokenizers")
MODEL = P.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"
ODD = [(900001, None), (900002, ""), (900003, "1234 !! ??"), (900004, "x " * 40_000), (900005, "a\x00b 日本語 🙂 ▁ \n\n"), (None, "no id here"), (900006, "the"), (900006, "the")]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(i, t, None, "s", 0) for i, t in ODD], docs.schema)
    clash = docs.unionByName(odd).selectExpr("*", "1 as score", "'x' as held_out", "2 as predicted", "3 as h", "4 as y")
    return clash, spark.read.parquet(f"{SF}/labels.parquet")


def accuracy(found, truth, col):
    rows = found.where("held_out").join(truth, "doc_id").select(F.col(col).alias("y"), "predicted").collect()
    good = {y: [r["predicted"] == y for r in rows if r["y"] == y] for y in (0, 1)}
    return {y: sum(v) / len(v) for y, v in good.items() if v}


def test_quality_on_held_out_rows(spark, tables):
    docs, labels = tables
    found = quality.score_quality(docs, labels).cache()
    acc = accuracy(found, labels, "quality")
    assert min(acc.values()) > 0.9
    assert found.count() == docs.count()
    assert found.where("score < 0 or score > 1 or score is null or held_out is null").count() == 0
    assert found.where(F.col("held_out") != (crc_mod(F.col("doc_id"), 4) == 2)).count() == 0
    twins = found.where("doc_id = 900006").select("score").distinct().count()
    assert twins == 1


def test_quality_without_labels(spark, tables):
    docs, labels = tables
    assert {r["score"] for r in quality.score_quality(docs.limit(5), labels.limit(0)).collect()} == {1.0}
    assert quality.score_quality(docs.limit(0), labels).count() == 0


def test_temperature_calibrates():
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 3))
    y = (x[:, 0] + r.normal(size=600) > 0).astype(float)
    net, w = quality.Network(), np.full(600, 1 / 600)
    net.fit(x[:300], y[:300], w[:300] * 2)
    before = net.probability(x[300:])
    net.calibrate(x[300:], y[300:], w[300:])
    loss = lambda p: -np.mean(np.where(y[300:] > 0, np.log(p), np.log(1 - p)))
    assert loss(np.clip(net.probability(x[300:]), 1e-9, 1 - 1e-9)) <= loss(np.clip(before, 1e-9, 1 - 1e-9)) + 1e-9


def test_language_on_held_out_rows(spark, tables):
    docs, _ = tables
    found = language_id.identify(docs, MODEL).cache()
    truth = docs.where("lang is not null").select("doc_id", "lang")
    rows = found.where("held_out").join(truth, "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    odd = {r["doc_id"]: r["lang_pred"] for r in found.where("doc_id > 900000").collect()}
    assert odd[900001] == odd[900002] == odd[900003] == "und" and odd[900006] != "und"
    assert found.count() == docs.count()
    assert found.where("score < 0 or score > 1 or score is null").count() == 0
    blank = docs.withColumn("lang", F.lit(None).cast("string")).limit(20)
    assert {r["lang_pred"] for r in language_id.identify(blank, MODEL).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), MODEL).count() == 0


def test_forward_sums_all_segmentations():
    r = random.Random(2)
    pieces = ["a", "b", "ab", "ba", "aba", "c", "cab", "é"]
    m = language_id.UnigramModel(pieces, ["x", "y"], np.zeros(2))
    m.p = np.array([[r.random() for _ in range(2)] for _ in pieces])

    def brute(w, k):
        total = 0.0
        for cuts in itertools.product([0, 1], repeat=len(w) - 1):
            at, prod, parts = 0, 1.0, []
            for i, c in enumerate((*cuts, 1), 1):
                if c:
                    parts.append(w[at:i])
                    at = i
            for p in parts:
                prod *= (m.p[pieces.index(p), k] if p in pieces else 0.0) + (m.floor if len(p) == 1 else 0.0)
            total += prod
        return total

    words = ["a", "abab", "cababa", "zz", "éa", "abcabz"]
    got = m.forward(words)
    for w, row in zip(words, got, strict=True):
        assert row.tolist() == pytest.approx([math.log(max(brute(w, k), 1e-300)) for k in range(2)])


def test_forward_takes_whole_letter_runs_and_long_pieces():
    pieces = language_id.letter_pieces(MODEL)
    assert "international" in pieces and "distribution" in pieces
    m = language_id.UnigramModel(pieces, ["x", "y"], np.zeros(2))
    m.p = np.random.default_rng(0).dirichlet(np.full(len(pieces), 0.3), 2).T
    number = {p: i for i, p in enumerate(pieces)}

    def log_sum(w):
        a = np.array([[1.0, 1.0]] + [[0.0, 0.0]] * len(w), np.longdouble)
        for j in range(1, len(w) + 1):
            for i in range(j):
                if w[i:j] in number:
                    a[j] += a[i] * m.p[number[w[i:j]]]
            a[j] += a[j - 1] * m.floor
        return np.log(a[-1]).astype(float)

    for w in ("international", "the" * 7 + "international" + "distribution", "日本語の" * 9 + "information", "q" * 90):
        parts = language_id.units(w, language_id.neighbours(pieces))
        assert "".join(parts) == w
        assert m.forward(parts).sum(axis=0).tolist() == pytest.approx(log_sum(w).tolist())


def test_long_words_are_fitted_like_short_ones():
    r = np.random.default_rng(1)
    pieces, words = ["a", "b", "ab", "aba"], ["ab" * 5, "abaab", "bz"]
    a, b = (language_id.UnigramModel(pieces, ["x", "y"], np.zeros(2)) for _ in range(2))
    a.p = b.p = r.random((4, 2))
    counts, one, two = r.random((3, 2)), np.zeros((4, 2)), np.zeros((4, 2))
    a._expect(words, counts, one)
    for w, c in zip(words, counts, strict=True):
        b._expect_long(w, c, two)
    assert two == pytest.approx(one)


def test_toxicity_on_held_out_rows(spark, tables):
    docs, labels = tables
    found = toxicity.score_toxicity(docs, labels).cache()
    rows = found.where("held_out").join(labels, "doc_id").select("toxic", "score").collect()
    bad, good = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    assert np.mean([b > g for b in bad for g in good]) > 0.8 and np.mean([g < 0.5 for g in good]) > 0.95
    assert found.count() == docs.count()
    assert found.where("score < 0 or score > 1 or score is null").count() == 0
    assert {r["predicted"] for r in found.where("doc_id in (900001, 900002, 900003)").collect()} == {0}
    assert {r["score"] for r in toxicity.score_toxicity(docs.limit(3), labels.limit(0)).collect()} == {0.0}


def test_string_kernel_tolerates_gaps():
    pos, neg = ["stupid", "moron", "pathetic", "worthless"], ["student", "morning", "sympathy", "worth", "house", "garden", "window", "letter", "number", "planet"]
    m = toxicity.train(pos + neg, pos, neg)
    score = lambda w: float(m.words(toxicity.clean(w)).max())
    worst = max(score(w) for w in neg)
    for w in ("stupid", "s.t.u.p.i.d", "st-upid", "stuupid", "m0ron", "worthlesss"):
        assert score(w) > worst
    assert "moron" in toxicity.tokens("you m o r o n there")


def test_subsequence_weights_by_brute_force():
    codes, w = toxicity.subsequences(["abc"], 3)
    a = [31, 1, 2, 3]
    want = {}
    for p in (3, 4):
        for at in itertools.combinations(range(4), p):
            code = 0 if p == 3 else 1 << 15
            value = 0
            for i in at:
                value = value * 32 + a[i]
            want[code + value] = want.get(code + value, 0) + toxicity.DECAY ** (at[-1] - at[0] - (p - 1))
    norm = math.sqrt(sum(v * v for v in want.values()))
    got = {}
    for c, x in zip(codes[0].tolist(), w.tolist(), strict=True):
        got[c] = got.get(c, 0) + x
    assert got == pytest.approx({k: v / norm for k, v in want.items()})


@pytest.fixture(scope="module")
def vocab():
    return nbest_pieces.Vocabulary(MODEL)


def brute_paths(v, word):
    edges = v.edges(word)
    out = []

    def go(i, s, path):
        if i == len(word):
            out.append((s, path))
            return
        for j, k, c in edges[i]:
            go(j, s + c, [*path, (i, j, k)])

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("word", ["▁the", "▁thention", "auxéçß", "▁", "▁日本🙂a", "\n", "▁ererer", "a\x00b", nbest_pieces.OWN_MARK + "ab"])
def test_n_best_is_exact(vocab, word):
    want, got = brute_paths(vocab, word), nbest_pieces.n_best(vocab, word, 6)
    assert [s for s, _ in got] == pytest.approx([s for s, _ in want[:6]]) and len(got) == min(6, len(want))
    top, margin, ids = nbest_pieces.Lattices(vocab)([word])
    assert top[0] == pytest.approx(want[0][0])
    if len(want) > 1:
        assert margin[0] == pytest.approx(want[0][0] - want[1][0], abs=1e-9)
    assert sum(vocab.score[i] if vocab.score[i] > nbest_pieces.NEVER else vocab.byte_score for i in np.frombuffer(ids[0], "<u4")) == pytest.approx(want[0][0])


def test_text_n_best_equals_brute_force(vocab):
    seg = nbest_pieces.Segmenter(vocab, 5)
    words = nbest_pieces.words_in("the cat sat the")
    at = seg.prepare([words])[0]
    got = [s for s, _ in seg.text_n_best(words, np.array(at))]
    want = sorted((sum(c) for c in itertools.product(*([s for s, _ in brute_paths(vocab, w)] for w in words))), reverse=True)[:5]
    assert got == pytest.approx(want)


def whole(text):
    """The text as one word, not split."""
    return text.replace(nbest_pieces.MARK, nbest_pieces.OWN_MARK).replace(" ", nbest_pieces.MARK)


@pytest.mark.parametrize("text", ["a   b", "  a b", "if x:\n    y", "a  ", "   ", " \n  \n", "a ▁  b"])
def test_runs_of_spaces_against_the_unsplit_text(vocab, text):
    seg = nbest_pieces.Segmenter(vocab, 5)
    words = nbest_pieces.words_in(text)
    at = seg.prepare([words])[0]
    got = [s for s, _ in seg.text_n_best(words, np.array(at))]
    want = [s for s, _ in brute_paths(vocab, whole(text))[:5]]
    assert got == pytest.approx(want)


@pytest.mark.parametrize("text", ["und.34@mail7.example.com", "see und.34@mail7.example.com now", "x" * 23 + "ation", " " * 37 + "z", "q" * 24 + "\x00é", "\n" + "日本" * 13])
def test_long_words_are_searched_whole(vocab, text):
    got_words, n, line = nbest_pieces.words_in(text), 5, whole(text)
    seg = nbest_pieces.Segmenter(vocab, n)
    at = seg.prepare([got_words])[0]
    got = [s for s, _ in seg.text_n_best(got_words, np.array(at))]
    # the n best of every prefix of the unsplit text, by plain enumeration of what can end there
    edges, tops = vocab.edges(line), [[0.0]] + [[] for _ in line]
    for i in range(len(line)):
        tops[i] = sorted(tops[i], reverse=True)[:n]
        for j, _, s in edges[i]:
            tops[j] += [t + s for t in tops[i]]
    assert got == pytest.approx(sorted(tops[-1], reverse=True)[:n])


def test_long_words_take_linear_time(vocab):
    for word in (" " * 30_000, "ab" * 15_000, "日" * 30_000):
        found = nbest_pieces.n_best(vocab, whole(word), 4)
        assert len(found) == 4 - 3 * (word[0] == "日") and all(p[0][0] == 0 and p[-1][1] == len(word) for _, p in found)


def unigram_model(vocab):
    """The library over the same pieces with our scores, as a unigram model: the public model's file with its kind and scores replaced."""
    import struct

    import sentencepiece

    def number(b, i):
        n = shift = 0
        while True:
            n, shift, i = n | (b[i] & 127) << shift, shift + 7, i + 1
            if b[i - 1] < 128:
                return n, i

    def written(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + written(n >> 7)

    def fields(b):
        i = 0
        while i < len(b):
            key, j = number(b, i)
            if key & 7 == 2:
                n, j = number(b, j)
                end, value = j + n, b[j : j + n]
            else:
                end = number(b, j)[1] if key & 7 == 0 else j + (4 if key & 7 == 5 else 8)
                value = b[j:end]
            yield key >> 3, value, b[i:end]
            i = end

    out, at = b"", 0
    with open(MODEL, "rb") as h:
        for field, value, whole in fields(h.read()):
            if field == 1:
                own = b"".join(w for f, _, w in fields(value) if f != 2)
                if vocab.score[at] > nbest_pieces.NEVER:
                    own += b"\x15" + struct.pack("<f", vocab.score[at])
                whole, at = b"\x0a" + written(len(own)) + own, at + 1
            elif field == 2:
                own = b"".join(w for f, _, w in fields(value) if f != 3) + b"\x18\x01"
                whole = b"\x12" + written(len(own)) + own
            out += whole
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def test_ids_are_those_of_the_library(spark, vocab):
    lib = unigram_model(vocab)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").selectExpr("doc_id", "substring(text, 1, 400) as text")
    rows, same = nbest_pieces.encode_texts(docs, MODEL, n=3, with_ids=True).collect(), 0
    by = {r["doc_id"]: r["text"] for r in docs.collect()}
    score = lambda ids: sum(vocab.score[i] if vocab.score[i] > nbest_pieces.NEVER else vocab.byte_score for i in ids)
    for r in rows:
        theirs = lib.encode(by[r["doc_id"]])
        same += theirs == r["ids"]
        assert theirs == r["ids"] or score(theirs) == pytest.approx(r["best_score"], abs=1e-3)  # the library adds in single precision
        assert lib.decode(r["ids"]) == by[r["doc_id"]] == vocab.decode(r["ids"])
        best = lib.nbest_encode(by[r["doc_id"]], nbest_size=3)
        assert [score(x) for x in best] == pytest.approx(r["n_best"][: len(best)], abs=2e-3)
    assert same > 0.95 * len(rows)


def test_encoding_round_trips(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as n_best")
    rows = nbest_pieces.encode_texts(df, MODEL, n=3, with_ids=True).collect()
    assert len(rows) == len(ODD) and all(r["round_trip"] for r in rows)
    v = nbest_pieces.Vocabulary(MODEL)
    by = dict(ODD)
    for r in rows:
        assert v.decode(r["ids"]) == (by[r["doc_id"]] or "") and r["n_best"] == sorted(r["n_best"], reverse=True)
        assert all(v.decode(a) == (by[r["doc_id"]] or "") for a in r["alternatives"]) and len(r["alternatives"]) == len(r["n_best"])
    assert nbest_pieces.encode_texts(df.limit(0), MODEL).count() == 0


def test_interner_numbers_in_order():
    i = Interner()
    assert [i[w] for w in "abca"] == [0, 1, 2, 0] and i.take() == ["a", "b", "c"] and i.take() == []
