"""Toxicity by a subsequence string-kernel SVM with Nystrom landmarks.

The kernel of two words counts their common subsequences of three and four letters, each weighted by a decay for every gap (spans up
to ``SPAN`` letters), so inserted or dropped characters cost little. Landmark words give the Nystrom map; a linear SVM in it is
collapsed into one weight for each subsequence, which makes scoring a table look-up. A sentence, and so a text,
takes the decision of its best matching word; Platt scaling turns it into a probability.
"""

from __future__ import annotations

import functools
import itertools
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, crc_mod, table
from .labelled import labelled_sample

SPAN, DECAY, LONGEST = 7, 0.5, 24
#: bounds of the fit: labelled rows of each class (expected), landmark words, words of each class in the SVM
FIT_ROWS, LANDMARKS, FIT_WORDS = 2000, 400, 2000
#: slack weights of the classes
POSITIVE, NEGATIVE = 3.0, 1.0
CACHED = 250_000
LETTERS = re.compile(r"[^\W\d_]+")
SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?!\w)")
LEET = str.maketrans("013457$@", "oieastsa")
CODES = (1 << 15) + (1 << 20)


@functools.lru_cache
def places(n: int, p: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Letter places and weights of the subsequences of p letters in a word of n."""
    t = [(i, *rest) for i in range(n) for rest in itertools.combinations(range(i + 1, min(n, i + SPAN)), p - 1)]
    at = [np.array(x, np.int64) for x in zip(*t, strict=True)] if t else [np.zeros(0, np.int64)] * p
    return at, DECAY ** (at[-1] - at[0] - (p - 1.0))


def letters_of(words: list[str], n: int) -> np.ndarray:
    """Letter classes 1..31 of words of n letters: a-z, four for all others, 31 for a word's start."""
    cp = np.array(words, dtype=f"U{n}").view(np.uint32).reshape(len(words), n).astype(np.int64)
    a = np.where((cp >= 97) & (cp <= 122), cp - 96, 27 + cp % 4)
    return np.concatenate([np.full((len(words), 1), 31), a], axis=1)


def subsequences(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (words x subsequences) and their weights, normalised by length, for words of n letters."""
    a = letters_of(words, n)
    (i, j, k), w3 = places(n + 1, 3)
    (q, r, s, t), w4 = places(n + 1, 4)
    codes = np.concatenate([a[:, i] * 1024 + a[:, j] * 32 + a[:, k], (1 << 15) + a[:, q] * 32768 + a[:, r] * 1024 + a[:, s] * 32 + a[:, t]], axis=1)
    w = np.concatenate([w3, w4])
    return codes, w / (math.sqrt(float((w**2).sum())) or 1.0)


def by_length(words: list[str]):
    groups: dict[int, list[int]] = {}
    for at, w in enumerate(words):
        groups.setdefault(len(w), []).append(at)
    return groups.items()


def embed(words: list[str], codes: np.ndarray) -> np.ndarray:
    """Feature vectors of words over some (sorted) subsequence codes."""
    out = np.zeros((len(words), len(codes)), np.float32)
    for n, at in by_length(words):
        c, w = subsequences([words[i] for i in at], n)
        col = np.minimum(np.searchsorted(codes, c), len(codes) - 1)
        ok = codes[col] == c
        for r, i in enumerate(at):
            np.add.at(out[i], col[r, ok[r]], w[ok[r]])
    return out


def codes_in(words: list[str]) -> np.ndarray:
    return np.unique(np.concatenate([np.unique(subsequences([words[i] for i in at], n)[0]) for n, at in by_length(words)]))


def clean(token: str) -> list[str]:
    """The words that a raw token may hide: its letter runs and their concatenation, cut to ``LONGEST`` letters with an overlap."""
    runs = LETTERS.findall(token)
    if not runs:
        return []
    t = token if token.isalpha() else token.translate(LEET)
    whole = "".join(LETTERS.findall(t))
    found = {whole, *runs} if len(runs) > 1 or whole != runs[0] else {whole}
    out = []
    for w in found:
        out += [w] if len(w) <= LONGEST else [w[i : i + LONGEST] for i in range(0, len(w) - SPAN, LONGEST - SPAN)]
    return [w for w in out if len(w) >= 3]


def tokens(text: str) -> list[str]:
    low = text.lower()
    out = low.split()
    spaced = SPACED.findall(low)
    return out + ["".join(LETTERS.findall(s)) for s in spaced] if spaced else out


class SubsequenceSVM:
    def __init__(self, u: np.ndarray, bias: float, platt: tuple[float, float] = (1.0, 0.0)):
        self.u, self.bias, self.platt = u, bias, platt

    def words(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), -2.0)
        for n, at in by_length(words):
            for a in range(0, len(at), 8192):
                part = at[a : a + 8192]
                codes, w = subsequences([words[i] for i in part], n)
                out[part] = self.u[codes] @ w + self.bias
        return out

    def probability(self, z):
        return 1.0 / (1.0 + np.exp(-np.clip(self.platt[0] * np.asarray(z) + self.platt[1], -40, 40)))


class Scorer:
    """Best word of each text; scores of tokens are kept for a worker."""

    def __init__(self, model: SubsequenceSVM):
        self.model, self.known = model, {}

    def __call__(self, texts: list) -> np.ndarray:
        split = [tokens(t) if t is not None else [] for t in texts]
        if len(self.known) > CACHED:
            self.known = {}
        known = self.known
        new = list({t for s in split for t in s if t not in known})
        parts = [clean(t) for t in new]
        flat = self.model.words([w for p in parts for w in p])
        at = 0
        for t, p in zip(new, parts, strict=True):
            known[t] = float(flat[at : at + len(p)].max()) if p else -2.0
            at += len(p)
        return np.array([max([known[t] for t in s]) if s else -2.0 for s in split])


def svm(x: np.ndarray, y: np.ndarray, c: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by Newton steps: min |w|^2 + sum c max(0, 1 - y f)^2."""
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(a.shape[1])
    reg = np.eye(a.shape[1])
    reg[-1, -1] = 1e-6
    for _ in range(rounds):
        on = y * (a @ w) < 1
        b = a[on] * c[on, None]
        nw = np.linalg.solve(reg + b.T @ a[on], b.T @ y[on])
        if np.allclose(nw, w, atol=1e-6):
            break
        w = nw
    return w[:-1], float(w[-1])


def train(landmarks: list[str], pos: list[str], neg: list[str]) -> SubsequenceSVM:
    codes = codes_in(landmarks)
    e = embed(landmarks, codes).astype(np.float64)
    val, vec = np.linalg.eigh(e @ e.T)
    keep = val > 1e-6 * val.max()
    basis = (vec[:, keep] / np.sqrt(val[keep])).T @ e  # rows: orthonormal directions in subsequence space

    wide = np.concatenate([basis.T, np.zeros((1, len(basis)))]).astype(np.float32)

    def features(words):
        out = np.zeros((len(words), len(basis)))
        for n, at in by_length(words):
            c, wt = subsequences([words[i] for i in at], n)
            col = np.minimum(np.searchsorted(codes, c), len(codes) - 1)
            col = np.where(codes[col] == c, col, len(codes))
            for t in range(c.shape[1]):
                out[at] += wt[t] * wide[col[:, t]]
        return out

    x = np.concatenate([features(pos), features(neg)])
    y = np.concatenate([np.ones(len(pos)), -np.ones(len(neg))])
    w, b = svm(x, y, np.where(y > 0, POSITIVE, NEGATIVE))
    u = np.zeros(CODES, np.float32)
    u[codes] = w @ basis
    return SubsequenceSVM(u, b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label: str, modulus: int, held_out: int) -> SubsequenceSVM | None:
    sample = labelled_sample(docs, labels, label, modulus, held_out, FIT_ROWS, id_col, text_col)
    spark = docs.sparkSession
    arrow_rows(spark, 512)
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    np_, nn = sizes.get(1, 0), sizes.get(0, 0)
    if not np_ or not nn:
        return None

    def count(batches):
        for pdf in batches:
            seen: dict[str, list[int]] = {}
            for text, y in zip(pdf["text"], pdf["y"], strict=True):
                for w in {w for t in set(tokens(text)) for w in clean(t)}:
                    seen.setdefault(w, [0, 0])[y] += 1
            yield pd.DataFrame([(w, a[1], a[0]) for w, a in seen.items()], columns=["w", "p", "n"])

    words = sample.mapInPandas(count, "w string, p long, n long").groupBy("w").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    # the log-likelihood ratio of a word's document counts between the classes
    p, n = F.col("p").cast("double"), F.col("n").cast("double")
    ep, en = (p + n) * np_ / (np_ + nn), (p + n) * nn / (np_ + nn)
    g = 2 * (F.when(p > 0, p * F.log(p / ep)).otherwise(0) + F.when(n > 0, n * F.log(n / en)).otherwise(0))
    words = words.withColumn("g", F.when(p / np_ > n / nn, g).otherwise(-g))
    top = words.orderBy(F.col("g").desc(), "w").limit(1000).collect()
    bar = 2 * math.log(max(100, words.count()))
    pos = [r["w"] for r in top if r["g"] > bar and r["n"] <= 0.05 * r["p"]] or [r["w"] for r in top[:10] if r["g"] > 0]
    neg_rows = words.where("n > 0").orderBy(F.col("n").desc(), "w").limit(FIT_WORDS).collect() + words.where("n > 0").orderBy(F.xxhash64("w"), "w").limit(FIT_WORDS).collect()
    neg = sorted({r["w"] for r in neg_rows} - set(pos))
    if not pos or not neg:
        return None

    def spread(words: list[str], most: int) -> list[str]:
        """Greedily, words that are not yet close to a chosen one."""
        e = embed(words[:1200], codes_in(words[:1200]))
        chosen: list[int] = []
        for i in range(len(e)):
            if len(chosen) < most and (not chosen or float((e[chosen] @ e[i]).max()) < 0.85):
                chosen.append(i)
        return [words[i] for i in chosen]

    marks = spread(pos, LANDMARKS // 2)
    model = train(marks + spread(neg, LANDMARKS - len(marks)), pos, neg)
    for _ in range(2):  # the clean texts' words that come nearest become landmarks and examples
        current = model

        def hardest(batches, current=current):
            scorer = Scorer(current)
            for pdf in batches:
                scorer([t for t, y in zip(pdf["text"], pdf["y"], strict=True) if y == 0])
                ws = sorted({w for t, z in scorer.known.items() if z > -0.7 for w in clean(t)})
                yield pd.DataFrame({"w": ws, "z": current.words(ws)}) if ws else pd.DataFrame({"w": [], "z": []}).astype({"w": str, "z": float})

        hard = [r["w"] for r in sample.where("y = 0").mapInPandas(hardest, "w string, z double").groupBy("w").agg(F.max("z").alias("z")).orderBy(F.col("z").desc(), "w").limit(FIT_WORDS).collect()]
        hard = [w for w in hard if w not in set(pos)]
        neg = sorted(set(neg) | set(hard))
        model = train(marks + spread(hard + neg, LANDMARKS - len(marks)), pos, neg)
    final = model

    def best(batches):
        scorer = Scorer(final)
        for pdf in batches:
            yield pd.DataFrame({"z": scorer(pdf["text"].tolist()), "y": pdf["y"]})

    rows = sample.mapInPandas(best, "z double, y int").collect()
    z, y = np.array([r["z"] for r in rows]), np.array([r["y"] for r in rows], float)
    model.platt = platt(z, y)
    return model


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic scaling with balanced class weights, by Newton steps."""
    wt = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    t = np.where(y > 0, 1 - 1e-3, 1e-3)
    x = np.stack([z, np.ones_like(z)], axis=1)
    b = np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        h = (x * (wt * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-5 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (wt * (p - t)) + 1e-5 * b)
        b -= np.clip(step, -2, 2)
    return float(b[0]), float(b[1])


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", modulus: int = 5, held_out: int = 0, threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (score >= threshold).

    Labels of rows whose crc32(id) mod ``modulus`` is ``held_out`` are never used. Null and empty texts, and texts without words, score as having no
    insult; if nothing can be learned every score is 0. Whole texts are scored; repeated rows each; other columns are not read.
    """
    spark = docs.sparkSession
    model = fit(docs, labels, id_col, text_col, label, modulus, held_out)
    arrow_rows(spark, 512)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value) if shared.value is not None else None
        for pdf in batches:
            s = scorer.model.probability(scorer(pdf["text"].tolist())) if scorer else np.zeros(len(pdf))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": s, "predicted": (s >= threshold).astype(np.int32)})

    rows = docs.select(F.col(id_col).alias("doc_id"), (crc_mod(F.col(id_col), modulus) == held_out).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
