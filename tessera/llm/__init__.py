"""Operators for large training corpora, one module each, and their registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import collocations, decontaminate, exact_dedup, langid, line_dedup, media_tiff, near_dedup, packing, sharding, substring_dedup, token_alignment, url_filter, warc

    found = (
        substring_dedup.op1_substring_dedup,
        media_tiff.op2_tiff_pages,
        packing.op3_best_fit_packing,
        sharding.op4_stratified_shards,
        langid.op5_language_id,
        url_filter.op6_url_filters,
        line_dedup.op7_line_dedup,
        warc.op8_warc,
        near_dedup.op9_bagminhash_near_dedup,
        decontaminate.op10_benchmark_decontamination,
        collocations.op11_phrase_collocations,
        exact_dedup.op12_tree_exact_dedup,
        token_alignment.op13_token_alignment,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return {k: v for k, v in oracles.SQL.items() if k in queries()}
