"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from sameword.llm import bpe, chat, exact_dedup, hnsw, interpolation, licenses, merkle, mixing, ngram_join, quality, resample, substrings, warc

QUERIES = {
    "op1_hnsw": hnsw.op1_hnsw,
    "op2_chat": chat.op2_chat,
    "op3_interpolation": interpolation.op3_interpolation,
    "op4_licenses": licenses.op4_licenses,
    "op5_bpe": bpe.op5_bpe,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_substrings": substrings.op7_substrings,
    "op8_mixing": mixing.op8_mixing,
    "op9_quality": quality.op9_quality,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_resample": resample.op11_resample,
    "op12_warc": warc.op12_warc,
    "op13_merkle": merkle.op13_merkle,
}
SQL = {"op2_chat": chat.ORACLE, "op10_exact_dedup": exact_dedup.ORACLE, "op11_resample": resample.ORACLE, "op12_warc": warc.ORACLE, "op13_merkle": merkle.ORACLE}
