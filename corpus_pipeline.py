"""A corpus pipeline of five stages: quality, near-duplicates, repeated passages, benchmark leaks, SentencePiece encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomill.llm.common import stash, table
from axiomill.llm.decontaminate import remove_contaminated
from axiomill.llm.minhash_dedup import near_duplicates
from axiomill.llm.nbest_pieces import encode_texts
from axiomill.llm.quality import score_quality
from axiomill.llm.suffix_dedup import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; null texts are scored as empty ones, repeated rows alike."""
    scored = score_quality(docs, table(spark, sf_dir, "labels"), keep=tuple(docs.columns), names=("__held_out", "__score", "__predicted"))
    return scored.where("__predicted = 1").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of near-duplicates; rows with a null id are in no group and stay, as do texts without
    words; repeated rows of a kept id all stay."""
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages of 100 bytes and more that also start earlier. Null texts become empty; repeated rows keep one copy
    of their text; null ids come before all others. Columns of any name are carried along."""
    rest = next(n for i in range(len(docs.columns) + 1) if (n := f"__rest{i}") not in docs.columns)
    packed = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(rest))
    out = remove_repeats(packed, keep_text=True, keep=(rest,))
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(own.get(c, F.col(f"{rest}.`{c}`")).alias(c) for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage; null and empty texts hold none, repeated rows are judged each."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece counts, ids' checksum, N-best scores and the exact round trip of each document; null and empty texts have no pieces, repeated rows a row each."""
    return encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("decontaminate", decontaminate), ("encode", encode)]

#: The stages hold a trained classifier and a piece lattice, which SQL does not express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
