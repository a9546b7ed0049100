"""Quality classifier: random-indexing word vectors, pooled per document, then a two-layer network with calibrated probabilities.

Every word has a sparse ternary index vector drawn from its hash; its word vector is that plus the normalised sum of its neighbours' index
vectors over the fitting rows. A document is the mean of its word vectors (words' forms - capitals, marks, immediate
repeats - are words of their own). The network is plain numpy; a temperature fitted on rows it never saw calibrates it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, crc_mod, release, table, trim
from .labelled import labelled_sample

DIM, NONZERO, HIDDEN, EPOCHS = 64, 8, 24, 400
#: bounds of the fit: labelled rows of each class (expected) and words with vectors
FIT_ROWS, VOCABULARY = 3000, 20_000
CACHED = 60_000
PARTS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
AGAIN, UNKNOWN = "<again>", "<unknown>"


def parts(token: str) -> list[str]:
    """A raw token as words: lower-cased letters with a form word, numbers, mark runs."""
    out = []
    for m in PARTS.findall(token):
        if m[0].isalpha():
            out.append(m.lower())
            if len(m) > 1 and m.isupper():
                out.append("<upper>")
        elif m[0].isdigit():
            out.append("<number>")
        else:
            out.append(m[:3])
    return out


def words(text: str) -> list[str]:
    out, before = [], None
    for t in text.split():
        if t == before:
            out.append(AGAIN)
        else:
            out += parts(t)
        before = t
    return out


def index_vectors(vocab: list[str]) -> np.ndarray:
    out = np.zeros((len(vocab), DIM), np.float32)
    for i, w in enumerate(vocab):
        r = np.random.default_rng(zlib.crc32(w.encode()))
        at = r.choice(DIM, NONZERO, replace=False)
        out[i, at[: NONZERO // 2]] = 1
        out[i, at[NONZERO // 2 :]] = -1
    return out


class Pooler:
    """Mean word vector of whole texts; each distinct raw token's vector sum is kept for a worker."""

    def __init__(self, vocab: list[str], vectors: np.ndarray):
        self.at = {w: i for i, w in enumerate(vocab)}
        self.vectors = vectors
        self.reset()

    def reset(self):
        self.known: dict[str, int] = {}
        self.sums, self.counts, self.n = np.zeros((1024, DIM), np.float32), np.zeros(1024, np.float32), 0

    def add(self, tokens: list[str]) -> None:
        need = self.n + len(tokens)
        if need > len(self.counts):
            size = max(need, 2 * len(self.counts))
            self.sums, self.counts = np.concatenate([self.sums, np.zeros((size - len(self.sums), DIM), np.float32)]), np.concatenate([self.counts, np.zeros(size - len(self.counts), np.float32)])
        unk = self.at.get(UNKNOWN, 0)
        for t in tokens:
            ids = [self.at.get(p, unk) for p in parts(t)]
            if ids:
                self.sums[self.n] = self.vectors[ids].sum(axis=0) if len(ids) > 1 else self.vectors[ids[0]]
            else:
                self.sums[self.n] = 0
            self.counts[self.n] = len(ids)
            self.known[t] = self.n
            self.n += 1

    def __call__(self, texts: list) -> np.ndarray:
        split = [t.split() if t is not None else [] for t in texts]
        if self.n > CACHED:
            self.reset()
        known = self.known
        self.add(list({t for s in split for t in s if t not in known}))
        out = np.zeros((len(texts), DIM + 1), np.float32)
        again = self.vectors[self.at[AGAIN]] if AGAIN in self.at else np.zeros(DIM, np.float32)
        for i, s in enumerate(split):
            if not s:
                continue
            ids = np.fromiter((known[t] for t in s), np.int64, len(s))
            rep = np.concatenate(([False], ids[1:] == ids[:-1]))
            k = int(rep.sum())
            if k:
                ids = ids[~rep]
            total, n = self.sums[ids].sum(axis=0) + k * again, float(self.counts[ids].sum()) + k
            out[i, :DIM] = total / max(1.0, n)
            out[i, DIM] = 1.0
        return out


class Network:
    """standardise -> tanh layer -> logit, divided by the temperature."""

    def __init__(self, seed: int = 5):
        self.seed, self.t = seed, 1.0

    def fit(self, x: np.ndarray, y: np.ndarray, wt: np.ndarray) -> None:
        r = np.random.default_rng(self.seed)
        self.m, self.s = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = (x - self.m) / self.s
        p = [r.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), r.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        for step in range(1, EPOCHS + 1):
            h = np.tanh(z @ p[0] + p[1])
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y) * wt
            back = np.outer(g, p[2]) * (1 - h * h)
            grads = [z.T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ g + 1e-4 * p[2], np.array([g.sum()])]
            for a, gr, mm, vv in zip(p, grads, m, v, strict=True):
                mm += 0.1 * (gr - mm)
                vv += 0.01 * (gr * gr - vv)
                a -= 0.02 * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)
        self.p = p

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.m) / self.s @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def calibrate(self, x: np.ndarray, y: np.ndarray, wt: np.ndarray) -> None:
        z = self.logit(x)
        grid = np.geomspace(0.25, 8, 40)
        loss = [float((wt * np.logaddexp(0, np.where(y > 0, -z, z) / t)).sum()) for t in grid]
        self.t = float(grid[int(np.argmin(loss))])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.t, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label: str, modulus: int, held_out: int):
    """(vocabulary, vectors, network); the class itself if only one was seen, None if there are no labels."""
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, label, modulus, held_out, FIT_ROWS, id_col, text_col)
    arrow_rows(spark, 256)

    def count(batches):
        release()
        for pdf in batches:
            c: Counter = Counter()
            for t in pdf["text"]:
                c.update(words(t))
            yield pd.DataFrame(list(c.items()), columns=["w", "n"])

    top = sample.mapInPandas(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "w").limit(VOCABULARY).collect()
    vocab = sorted({r["w"] for r in top} | {AGAIN, UNKNOWN, "<upper>", "<number>"})
    index = index_vectors(vocab)

    def context(batches):
        """One dense sum of neighbours' index vectors for each task; the sample, and so the number of tasks, is bounded."""
        at = {w: i for i, w in enumerate(vocab)}
        total = np.zeros((len(vocab), DIM), np.float32)
        for pdf in batches:
            for t in pdf["text"]:
                ids = np.array([at.get(w, at[UNKNOWN]) for w in words(t)], np.int64)
                for d in (1, 2):
                    for a, b in ((ids[:-d], ids[d:]), (ids[d:], ids[:-d])):
                        if len(a):
                            pair, n = np.unique(a * len(vocab) + b, return_counts=True)
                            a_, b_ = pair // len(vocab), pair % len(vocab)
                            cut = np.flatnonzero(np.diff(a_, prepend=-1))
                            total[a_[cut]] += np.add.reduceat(index[b_] * n[:, None].astype(np.float32), cut, axis=0)
        yield pd.DataFrame({"m": [total.tobytes()]})

    neighbours = sum((np.frombuffer(r["m"], np.float32).reshape(-1, DIM).astype(np.float64) for r in sample.coalesce(4).mapInPandas(context, "m binary").toLocalIterator()), np.zeros((len(vocab), DIM)))
    norm = np.linalg.norm(neighbours, axis=1, keepdims=True)
    vectors = (index / np.sqrt(NONZERO) + neighbours / np.maximum(norm, 1e-9)).astype(np.float32)

    def pool(batches):
        pooler = Pooler(vocab, vectors)
        for pdf in batches:
            x = pooler(pdf["text"].tolist())
            yield pd.DataFrame({"x": [v.tobytes() for v in x], "y": pdf["y"], "h": pdf["h"]})

    rows = sample.mapInPandas(pool, "x binary, y int, h long").collect()
    if len({r["y"] for r in rows}) < 2:
        return float(rows[0]["y"]) if rows else None
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], np.float64)
    y, check = np.array([r["y"] for r in rows], float), np.array([r["h"] % 5 == 0 for r in rows])
    order = np.lexsort(np.concatenate([x.T, y[None]]))  # rows come in any order; the network's sums should not
    x, y, check = x[order], y[order], check[order]
    if len(set(y[~check])) < 2:
        check[:] = False
    wt = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    net = Network()
    net.fit(x[~check], y[~check], wt[~check] / wt[~check].sum())
    if check.any():
        net.calibrate(x[check], y[check], wt[check])
    del rows, x, neighbours, index
    trim()  # the driver keeps the model alone
    return vocab, vectors, net


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", modulus: int = 4, held_out: int = 2, threshold: float = 0.7, keep: tuple[str, ...] | None = None, names: tuple[str, str, str] = ("held_out", "score", "predicted")) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (score >= threshold); or the columns in ``keep`` and those three,
    under ``names`` that do not clash with them.

    Labels of rows whose crc32(id) mod ``modulus`` is ``held_out`` are never used; a null id counts as remainder 0 and has no label. Null and empty texts are
    pooled to the zero vector and scored as such. If only one class can be learned from, every score is that class (0 or 1); without any label nothing speaks against a text and it
    is 1. Whole texts are scored, repeated rows each and alike; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    model = fit(docs, labels, id_col, text_col, label, modulus, held_out)
    arrow_rows(spark, 128)
    shared = spark.sparkContext.broadcast(model)
    own = [F.col(id_col).alias("doc_id")] if keep is None else [F.col(f"`{c}`") for c in keep]
    body = text_col if keep is not None and text_col in keep else "__text"  # a kept text is not sent twice
    rows = docs.select(*own, (crc_mod(F.col(id_col), modulus) == held_out).alias(names[0]), *([F.col(text_col).alias(body)] if body == "__text" else []))

    def run(batches):
        release()
        same = 1.0 if shared.value is None else shared.value
        vocab, vectors, net = same if isinstance(same, tuple) else (None, None, None)
        pooler = Pooler(vocab, vectors) if net else None
        for pdf in batches:
            s = net.probability(pooler(pdf[body].tolist()).astype(np.float64)) if net else np.full(len(pdf), same)
            out = pdf.assign(**{names[1]: s, names[2]: (s >= threshold).astype(np.int32)})
            yield out.drop(columns="__text") if body == "__text" else out
        del pooler
        trim()

    fields = T.StructType([f for f in rows.schema.fields if f.name != "__text"]).add(names[1], T.DoubleType()).add(names[2], T.IntegerType())
    return rows.mapInPandas(run, fields)


def query(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
