"""Queries ``opN_<name>`` over the whole tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": Q.op1_suffix_array_dedup,
    "op2_mix_sources": Q.op2_mix_sources,
    "op3_url_filters": Q.op3_url_filters,
    "op4_best_fit_packing": Q.op4_best_fit_packing,
    "op5_simhash_near_dedup": Q.op5_simhash_near_dedup,
    "op6_exact_dedup": Q.op6_exact_dedup,
    "op7_document_fingerprints": Q.op7_document_fingerprints,
    "op8_pii_surrogates": Q.op8_pii_surrogates,
    "op9_secret_scan": Q.op9_secret_scan,
    "op10_toxicity": Q.op10_toxicity,
    "op11_fill_in_middle": Q.op11_fill_in_middle,
    "op12_license_scan": Q.op12_license_scan,
    "op13_conversation_repair": Q.op13_conversation_repair,
}
ORACLES: dict[str, str] = {
    "op2_mix_sources": Q.OP2_SQL,
    "op3_url_filters": Q.OP3_SQL,
    "op6_exact_dedup": Q.OP6_SQL,
    "op12_license_scan": Q.OP12_SQL,
}
