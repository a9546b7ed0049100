"""Queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from . import decontaminate, language_id, minhash_dedup, nbest_pieces, quality, suffix_dedup, token_files, topk, toxicity, url_filters

QUERIES = {
    "op1_quality": quality.query,
    "op2_suffix_dedup": suffix_dedup.query,
    "op3_token_files": token_files.query,
    "op4_language_id": language_id.query,
    "op5_toxicity": toxicity.query,
    "op6_minhash_dedup": minhash_dedup.query,
    "op7_url_filters": url_filters.query,
    "op8_exact_topk": topk.query,
    "op9_nbest_pieces": nbest_pieces.query,
    "op10_decontaminate": decontaminate.query,
}

SQL = {
    "op2_suffix_dedup": suffix_dedup.SQL,
    "op6_minhash_dedup": minhash_dedup.SQL,
    "op7_url_filters": url_filters.SQL,
    "op8_exact_topk": topk.SQL,
    "op10_decontaminate": decontaminate.SQL,
}
