"""Language identification by segmentation-marginalised unigrams.

Each language has piece probabilities over one fixed public vocabulary, fitted by expectation-maximisation. A word's probability
in a language is the sum over all its segmentations into pieces, by the forward algorithm; a text's is the
product over its words. Words are scored once for a worker and looked up after that.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, crc_mod, table

#: longest unit scored many at once, in letters (longer ones are scored one by one, whole); words scored at once
UNIT, BLOCK = 24, 8192
#: bounds of the fit: labelled rows for each language (expected), rounds of EM
FIT_ROWS, ROUNDS = 1500, 3
#: units, and letters of long units, that a worker keeps
CACHED, CACHED_LONG = 250_000, 2_000_000
LETTERS = re.compile(r"[^\W\d_]+")
STEP = np.uint64(0x9E3779B97F4A7C15)


def letter_pieces(model_path: str) -> list[str]:
    """The vocabulary: the letter-only pieces of a public sentencepiece model, word marks removed, lower-cased."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    found = {sp.id_to_piece(i).replace("▁", "").lower() for i in range(sp.get_piece_size())}
    return sorted(p for p in found if p.isalpha())


def neighbours(pieces: list[str]) -> set[str]:
    """All two letters side by side in a piece. Between other two every segmentation parts."""
    return {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}


def units(text: str, joins: set[str]) -> list[str]:
    """Letter runs, the long ones parted where no piece goes across, which leaves their sums the same."""
    out = []
    for w in LETTERS.findall(text.lower()):
        if len(w) <= UNIT:
            out.append(w)
        else:
            at = [0, *(i for i in range(1, len(w)) if w[i - 1 : i + 1] not in joins), len(w)]
            out += [w[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
    return out


def code_points(words: list[str]) -> np.ndarray:
    return np.array(words, dtype=f"U{UNIT}").view(np.uint32).reshape(len(words), UNIT).astype(np.uint64)


class Lattice:
    """For every start and length the piece that a substring is (or -1), for many words at once, through an exact hash table."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.number, self.longest, self.joins = {p: i for i, p in enumerate(pieces)}, max(map(len, pieces), default=1), neighbours(pieces)
        keys = np.zeros(len(pieces), np.uint64)
        for i, p in enumerate(pieces):
            h = 0
            for c in p:
                h = (h * int(STEP) + ord(c) + 1) & (2**64 - 1)
            keys[i] = h
        order = np.argsort(keys)
        self.keys, self.index = keys[order], order
        self.seen = np.zeros(1 << 18, bool)
        self.seen[(keys >> np.uint64(46)).astype(np.int64)] = True

    def edges(self, cp: np.ndarray):
        """Yields (start, length, rows, piece indices): the words that have that piece there."""
        n, width = cp.shape
        for start in range(width):
            live = np.flatnonzero(cp[:, start] > 0)
            h = np.zeros(len(live), np.uint64)
            for size in range(1, min(self.longest, width - start) + 1):
                c = cp[live, start + size - 1]
                go = c > 0
                if not go.all():
                    live, h, c = live[go], h[go], c[go]
                if not len(live):
                    break
                with np.errstate(over="ignore"):
                    h = h * STEP + (c + np.uint64(1))
                maybe = np.flatnonzero(self.seen[(h >> np.uint64(46)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
                ok = self.keys[at] == h[maybe]
                yield start, size, live[maybe[ok]], self.index[at[ok]], (live if size == 1 else None)


class UnigramModel:
    """Per-language piece probabilities p[piece, language]; unknown letters have probability ``floor``."""

    floor = 1e-9

    def __init__(self, pieces: list[str], langs: list[str], prior: np.ndarray):
        self.lattice, self.langs, self.prior = Lattice(pieces), langs, prior
        self.p = np.full((len(pieces), len(langs)), 1.0 / max(1, len(pieces)))

    def forward(self, words: list[str]) -> np.ndarray:
        """log P(word | language), all segmentations summed: words x languages."""
        out = np.zeros((len(words), len(self.langs)))
        short = [i for i, w in enumerate(words) if len(w) <= UNIT]
        for at in (short[i : i + BLOCK] for i in range(0, len(short), BLOCK)):
            out[at] = np.log(np.maximum(self._forward([words[i] for i in at])[0], 1e-300))
        for i, w in enumerate(words):
            if len(w) > UNIT:
                out[i] = self._along(w, self._edges(w))[-1]
        return out

    def _edges(self, word: str) -> list[list[tuple[int, int | None, np.ndarray]]]:
        """For each place the (start, piece or None, probabilities) that end there."""
        out: list = [[]]
        for j in range(1, len(word) + 1):
            own = [(j - 1, None, np.full(len(self.langs), self.floor))]
            for i in range(max(0, j - self.lattice.longest), j):
                q = self.lattice.number.get(word[i:j])
                if q is not None:
                    own.append((i, q, self.p[q]))
            out.append(own)
        return out

    def _along(self, word: str, edges) -> np.ndarray:
        """Logs of the sums up to each place of a long word, whose products are too small for themselves."""
        a = np.zeros((len(word) + 1, len(self.langs)))
        for j in range(1, len(word) + 1):
            a[j] = a[j - 1] + np.log(sum(np.exp(a[i] - a[j - 1]) * x for i, _, x in edges[j]))
        return a

    def _expect_long(self, word: str, counts: np.ndarray, expected: np.ndarray) -> None:
        edges = self._edges(word)
        a, m = self._along(word, edges), len(word)
        after: list[list] = [[] for _ in range(m + 1)]
        for j in range(1, m + 1):
            for i, q, x in edges[j]:
                after[i].append((j, q, x))
        b = np.zeros_like(a)
        for i in range(m - 1, -1, -1):
            b[i] = b[i + 1] + np.log(sum(np.exp(b[j] - b[i + 1]) * x for j, _, x in after[i]))
            for j, q, x in after[i]:
                if q is not None:
                    expected[q] += np.exp(a[i] + b[j] - a[m]) * x * counts

    def _forward(self, words: list[str]):
        cp = code_points(words)
        n, k = len(words), len(self.langs)
        length = (cp > 0).sum(axis=1)
        a = np.zeros((UNIT + 1, n, k))
        a[0] = 1.0
        for start, size, rows, piece, first in self.lattice.edges(cp):
            if first is not None:
                a[start + 1, first] += a[start, first] * self.floor
            a[start + size, rows] += a[start, rows] * self.p[piece]
        return a[length, np.arange(n)], a, cp, length

    def em_round(self, words: list[str], counts: np.ndarray) -> None:
        """Expected piece counts under each language's own words (counts: words x languages), then new probabilities."""
        expected = np.zeros_like(self.p)
        short = [i for i, w in enumerate(words) if len(w) <= UNIT]
        for at in (short[i : i + BLOCK] for i in range(0, len(short), BLOCK)):
            self._expect([words[i] for i in at], counts[at], expected)
        for i, w in enumerate(words):
            if len(w) > UNIT:
                self._expect_long(w, counts[i], expected)
        alpha = 0.01
        self.p = (expected + alpha) / (expected.sum(axis=0) + alpha * len(self.p))

    def _expect(self, words: list[str], counts: np.ndarray, expected: np.ndarray) -> None:
        total, a, cp, length = self._forward(words)
        n, k = len(words), len(self.langs)
        b = np.zeros((UNIT + 1, n, k))
        b[length, np.arange(n)] = 1.0
        steps = list(self.lattice.edges(cp))
        scale = counts / np.maximum(total, 1e-300)
        for start, size, rows, piece, first in sorted(steps, key=lambda s: -s[0]):
            if first is not None:
                b[start, first] += b[start + 1, first] * self.floor
            b[start, rows] += b[start + size, rows] * self.p[piece]
        for start, size, rows, piece, _ in steps:
            np.add.at(expected, piece, a[start, rows] * self.p[piece] * b[start + size, rows] * scale[rows])


def fit(docs: DataFrame, model_path: str, id_col: str, text_col: str, lang_col: str) -> UnigramModel | None:
    """Fitted on a bounded sample of labelled rows: about ``FIT_ROWS`` for each language by a hash of the row, with all their units."""
    spark = docs.sparkSession
    learn = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (crc_mod(F.col(id_col), 3) != 1)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)).alias("h"))
    sizes = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    cut = functools.reduce(lambda c, x: c.when(F.col("lang") == x, F.lit(int(min(1.0, FIT_ROWS / sizes[x]) * (1 << 20)))), langs, F.when(F.lit(False), F.lit(0)))
    arrow_rows(spark, 1024)
    pieces = letter_pieces(model_path)
    joins = neighbours(pieces)

    def count(batches):
        from collections import Counter

        for pdf in batches:
            c: Counter = Counter()
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                c.update((lang, u) for u in units(text, joins))
            yield pd.DataFrame([(a, b, n) for (a, b), n in c.items()], columns=["lang", "unit", "n"])

    counted = learn.where(F.col("h") < cut).select("lang", "text").mapInPandas(count, "lang string, unit string, n long").groupBy("lang", "unit").agg(F.sum("n").alias("n"))
    top = counted.orderBy("lang", "unit").collect()
    prior = np.log(np.array([sizes[x] for x in langs], float) / sum(sizes.values()))
    model = UnigramModel(pieces, langs, prior)
    vocab = sorted({r["unit"] for r in top})
    at, lang_at = {w: i for i, w in enumerate(vocab)}, {x: i for i, x in enumerate(langs)}
    c = np.zeros((len(vocab), len(langs)))
    for r in top:
        c[at[r["unit"]], lang_at[r["lang"]]] = r["n"]
    # pieces that the fit has not seen still score by the smoothed probabilities
    for _ in range(ROUNDS if vocab else 0):
        model.em_round(vocab, c)
    return model


class Scorer:
    def __init__(self, model: UnigramModel):
        self.model, self.at, self.rows, self.long = model, {}, np.zeros((0, len(model.langs))), 0

    def __call__(self, texts: list) -> tuple[list[str], list[float]]:
        split = [units(t, self.model.lattice.joins) if t is not None else [] for t in texts]
        if len(self.at) > CACHED or self.long > CACHED_LONG:
            self.at, self.rows, self.long = {}, self.rows[:0], 0
        new = list({u for s in split for u in s if u not in self.at})
        if new:
            base = len(self.rows)
            self.rows = np.concatenate([self.rows, self.model.forward(new)])
            self.long += sum(len(u) for u in new if len(u) > UNIT)
            self.at.update(zip(new, range(base, base + len(new)), strict=True))
        langs, scores = [], []
        for t, s in zip(texts, split, strict=True):
            at = self.at
            total = self.rows[[at[u] for u in s]].sum(axis=0) if s else None
            if total is None or not any(ch.isalpha() for u in s for ch in u):
                langs.append("und")
                scores.append(0.0)
                continue
            z = total + self.model.prior
            best = int(z.argmax())
            langs.append(self.model.langs[best])
            scores.append(float(1.0 / np.exp(z - z[best]).sum()))
        return langs, scores


def identify(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score (the posterior of the predicted language).

    Learned from text and non-null lang of rows whose crc32(id) mod 3 is not 1. Null texts, and texts without a letter, are ``und``
    with score 0, as is everything if nothing can be learned. Whole texts and whole letter runs of any length are
    scored. Repeated rows are scored each; other columns are not read.
    """
    spark = docs.sparkSession
    model = fit(docs, model_path, id_col, text_col, lang_col)
    arrow_rows(spark, 512)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value) if shared.value is not None else None
        for pdf in batches:
            langs, scores = scorer(pdf["text"].tolist()) if scorer else (["und"] * len(pdf), [0.0] * len(pdf))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "lang_pred": langs, "score": scores})

    rows = docs.select(F.col(id_col).alias("doc_id"), (crc_mod(F.col(id_col), 3) == 1).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark, sf_dir):
    import public_tokenizers

    return identify(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
