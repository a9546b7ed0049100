"""Exact top-k inner-product search: columnar branch-and-bound over integer vectors.

Vectors are packed into blocks in vertical layout (one row for each dimension). A query adds
its product up dimension block by dimension block; after each block the Cauchy-Schwarz bound of the remaining mass
decides which candidates may still reach the k-th score, and the survivors are compacted.
Every block of queries meets every block of candidates (a stated query set against all rows): a task takes a few candidate blocks for one
query block and carries each query's k-th score from block to block; winners are merged by rank.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, table

#: candidates and queries in a block, dimensions added between two prunings, and the most candidate blocks that a task takes one after the other
CANDIDATES, QUERIES, DIMS, PER_TASK = 4096, 8192, 16, 16


def quantized(df: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) in doubles; rows with a null id, a null vector or a null or non-finite component go."""
    ok = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("v"))


def pack(pdf: pd.DataFrame) -> tuple[bytes, bytes, int]:
    """ids and the vertical matrix (dims x rows) in the narrowest integer type; shorter vectors are padded with zeros."""
    pdf = pdf.sort_values("vec_id", kind="stable")
    d = max((len(v) for v in pdf["v"]), default=0)
    m = np.zeros((len(pdf), d), np.int64)
    for i, v in enumerate(pdf["v"]):
        m[i, : len(v)] = v
    narrow = np.int16 if m.size == 0 or np.abs(m).max() < 2**15 else np.int64
    return pdf["vec_id"].to_numpy(np.int64).tobytes(), np.ascontiguousarray(m.T.astype(narrow)).tobytes(), d if narrow is np.int16 else -d - 1


def unpack(ids: bytes, m: bytes, d: int) -> tuple[np.ndarray, np.ndarray]:
    wide = d < 0
    d = -d - 1 if wide else d
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(m, np.int64 if wide else np.int16).reshape(d, len(i))


def exact_type(q: np.ndarray, c: np.ndarray):
    """The narrowest type in which every partial sum is exact."""
    if not q.size or not c.size:
        return np.float64
    most = float(np.abs(q.astype(np.float64)).max()) * float(np.abs(c.astype(np.float64)).max()) * max(1, min(len(q), len(c)))
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def upper(part: np.ndarray, rest: float, mass: np.ndarray, d: int) -> np.ndarray:
    """A bound in doubles that no exact score exceeds: parts are exact integers; root, sums and product of d squares are off by less than
    d + 8 units of 2**-52, the last sum by one unit of its terms, and both are added on twice over."""
    most = rest * mass * (1 + (d + 8) * 2.0**-50)
    return part + most + (np.abs(part) + most) * 2.0**-50


def search_block(q_ids, q, c_ids, c, k: int, floors: list | None = None):
    """Top k of one candidate block for each query: (query_id, vec_id, score) lists. Ties go to the smaller id. ``floors``: scores that
    each query is known to reach k times (None: unknown); what is below them may be left out."""
    d = max(len(q), len(c))
    kind = exact_type(q, c)
    qm = np.zeros((len(q_ids), d), kind)
    qm[:, : len(q)] = q.T.astype(kind) if kind is not object else q.T.astype(object)
    cm = np.zeros((d, len(c_ids)), kind)
    cm[: len(c)] = c.astype(kind)
    cf = cm.astype(np.float64)
    cuts = list(range(0, d, DIMS)) or [0]
    mass = np.zeros((len(cuts) + 1, len(c_ids)))  # norm of what is left of each candidate from a cut on
    for i in range(len(cuts) - 1, -1, -1):
        b = cf[cuts[i] : cuts[i] + DIMS]
        mass[i] = np.einsum("ij,ij->j", b, b) + mass[i + 1]
    mass = np.sqrt(mass)
    qs, vs, ss = [], [], []
    for r, qid in enumerate(q_ids):
        row = qm[r]
        rest = np.sqrt(np.concatenate([np.cumsum(row[::-1].astype(np.float64) ** 2)[::-1], [0.0]]))
        alive = None if len(c_ids) == 0 or not (c_ids == qid).any() else np.flatnonzero(c_ids != qid)
        part = np.zeros(len(c_ids) if alive is None else len(alive), kind)
        floor = floors[r] if floors is not None and floors[r] is not None and kind is not object else None
        for i, at in enumerate(cuts):
            block = cm[at : at + DIMS] if alive is None else cm[at : at + DIMS, alive]
            part = part + row[at : at + DIMS] @ block
            end = min(at + DIMS, d)
            if end >= d or (len(part) <= k and floor is None) or not len(part):
                continue
            if kind is object:
                continue  # bounds in doubles would not be safe here: plain exact sums
            idx = alive if alive is not None else slice(None)
            bound = upper(part.astype(np.float64), rest[end], mass[i + 1][idx], d)
            if floor is None:
                # full scores of the k best so far give a score that the k-th surely reaches
                lead = np.argpartition(part, len(part) - k)[-k:]
                full = row @ cm[:, lead if alive is None else alive[lead]]
                floor = float(full.min())
            keep = bound >= floor
            if keep.mean() < 0.7:
                alive = np.flatnonzero(keep) if alive is None else alive[keep]
                part = part[keep]
        ids = c_ids if alive is None else c_ids[alive]
        if len(part) > k and kind is not object:
            low = np.partition(part, len(part) - k)[len(part) - k]
            sel = np.flatnonzero(part >= low)
            part, ids = part[sel], ids[sel]
        score = [int(x) for x in part]
        order = sorted(range(len(score)), key=lambda j: (-score[j], ids[j]))[:k]
        qs += [qid] * len(order)
        vs += [int(ids[j]) for j in order]
        ss += [score[j] for j in order]
    return qs, vs, ss


class Best:
    """The k best of each query so far, over the candidate blocks of one task."""

    def __init__(self, k: int):
        self.k, self.found = k, {}

    def floors(self, q_ids) -> list:
        return [float(own[-1][0] * -1) if len(own := self.found.get(int(q), ())) >= self.k else None for q in q_ids]

    def add(self, qs, vs, ss) -> None:
        new: dict[int, list] = {}
        for q, v, s in zip(qs, vs, ss, strict=True):
            new.setdefault(int(q), []).append((-s, v))
        for q, own in new.items():
            self.found[q] = sorted([*self.found.get(q, ()), *own])[: self.k]

    def frame(self) -> pd.DataFrame:
        rows = [(q, v, -s) for q, own in self.found.items() for s, v in own]
        if any(not -(2**63) <= s < 2**63 for _, _, s in rows):
            raise OverflowError("a score does not fit 64 bits: use a smaller scale")
        return pd.DataFrame({"query_id": np.array([r[0] for r in rows], np.int64), "vec_id": np.array([r[1] for r in rows], np.int64), "score": np.array([r[2] for r in rows], np.int64)})


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64) -> DataFrame:
    """For each row with id % every == 0 the k largest integer inner products with every other row.

    Returns query_id, rank (from 1), vec_id, score (long). Ties: smaller vec_id. Rows whose id or vector is null, or that hold
    null or non-finite components, take no part; shorter vectors count as padded with zeros; rows that share the
    query's id are its own and not candidates; repeated candidates each count. Fewer than k candidates: all. An empty table: no rows.
    A score among the results that does not fit 64 bits is an error. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = quantized(vectors, id_col, vec_col, scale)
    n, nq = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    nc, nb = max(1, math.ceil(n / CANDIDATES)), max(1, math.ceil(nq / QUERIES))
    arrow_rows(spark, 4096)
    shape = "b int, ids binary, m binary, d int"
    # a task takes so many candidate blocks that all cores have work, and never more than bound its memory
    each = max(1, min(PER_TASK, nc * nb // max(1, 4 * spark.sparkContext.defaultParallelism)))
    lots = math.ceil(nc / each)

    def blocks(df, count):
        def put(key, pdf: pd.DataFrame) -> pd.DataFrame:
            i, m, d = pack(pdf)
            return pd.DataFrame({"b": [int(key[0])], "ids": [i], "m": [m], "d": [d]})

        return df.withColumn("b", F.pmod(F.xxhash64("vec_id", "v"), F.lit(count)).cast("int")).groupBy("b").applyInPandas(put, shape)

    cs = blocks(rows, nc).select(F.col("ids").alias("c_ids"), F.col("m").alias("c_m"), F.col("d").alias("c_d"), F.pmod("b", F.lit(lots)).alias("lot")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    qs = blocks(rows.where(F.col("vec_id") % every == 0).distinct(), nb).withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))

    def search(batches):
        at, best = None, Best(k)
        for pdf in batches:
            for t in pdf.itertuples(index=False):
                if (t.b, t.lot) != at:
                    if best.found:
                        yield best.frame()
                    at, best = (t.b, t.lot), Best(k)
                q_ids, q = unpack(t.ids, t.m, t.d)
                c_ids, c = unpack(t.c_ids, t.c_m, t.c_d)
                best.add(*search_block(q_ids, q, c_ids, c, k, best.floors(q_ids)))
        if best.found:
            yield best.frame()

    # no column but the packed blocks goes to Python; a pair of blocks is a few MB
    pairs = cs.hint("shuffle_merge").join(qs, ["b", "lot"]).repartition(nb * lots, "b", "lot").sortWithinPartitions("b", "lot")
    found = pairs.mapInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
