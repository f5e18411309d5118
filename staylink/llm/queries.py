"""The registered queries of this subpackage, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from staylink.llm import chat_format, collocations, decontam, fill_middle, lattice_dedup, license_scan, line_dedup, packing, phrase_dedup, signature_join, token_count, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_phrase_dedup": phrase_dedup.op1_phrase_dedup,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_embedding_near_dedup": lattice_dedup.op5_embedding_near_dedup,
    "op6_decontamination": decontam.op6_decontamination,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_ngram_jaccard_join": signature_join.op8_ngram_jaccard_join,
    "op9_token_counts": token_count.op9_token_counts,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_fill_middle": fill_middle.op11_fill_middle,
    "op12_license_scan": license_scan.op12_license_scan,
    "op13_collocations": collocations.op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op1_phrase_dedup": phrase_dedup.SQL,
    "op2_chat_format": chat_format.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op5_embedding_near_dedup": lattice_dedup.SQL,
    "op6_decontamination": decontam.SQL,
    "op8_ngram_jaccard_join": signature_join.SQL,
    "op11_fill_middle": fill_middle.SQL,
    "op12_license_scan": license_scan.SQL,
    "op13_collocations": collocations.SQL,
}
