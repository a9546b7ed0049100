"""A bounded, class-balanced sample of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, stash


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y, h): about ``rows`` labelled documents of each class, chosen by a hash of the id; held-out ids and null texts or labels never.

    Copies and near copies would teach their chance words, so of texts with the same least sentence hash (under two hashes) one stays.
    Only ids travel to the broadcast side, and their number is bounded by ``rows``; repeated labels of an id count once (the larger).
    """
    own = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(F.col(id_col), modulus) != held_out)).groupBy(F.col(id_col).alias("l_id")).agg(F.max(label).cast("int").alias("y"))
    own = own.where("y in (0, 1)").withColumn("h", F.pmod(F.xxhash64("l_id", F.lit(7)), F.lit(1 << 30)))
    sizes = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    cut = {y: int(min(1.0, rows / n) * (1 << 30)) for y, n in sizes.items()}
    picked = own.where(((F.col("y") == 0) & (F.col("h") < cut.get(0, 0))) | ((F.col("y") == 1) & (F.col("h") < cut.get(1, 0))))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("l_id"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(picked), "l_id").select("text", "y", "h")
    sentences = F.split(F.lower("text"), r"[.!?\n|]+\s*")
    for seed in (1, 2):
        least = sample.withColumn("m", F.array_min(F.transform(sentences, lambda x, seed=seed: F.xxhash64(x, F.lit(seed)))))
        sample = least.groupBy("y", "m").agg(F.min(F.struct("h", "text")).alias("r")).select("r.text", "y", "r.h")
    return stash(sample, "labelled")
