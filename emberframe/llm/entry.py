"""The subpackage's registered queries and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cdc, exact_dedup, html_text, mixing, pieces, pii, quality, sharding, simhash, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_trees": quality.op1_quality_trees,
    "op2_virtual_slots": sharding.op2_virtual_slots,
    "op3_piece_sampling": pieces.op3_piece_sampling,
    "op4_simhash_pivots": simhash.op4_simhash_pivots,
    "op5_tree_merge": exact_dedup.op5_tree_merge,
    "op6_pii_field": pii.op6_pii_field,
    "op7_cdc_spans": cdc.op7_cdc_spans,
    "op8_html_template": html_text.op8_html_template,
    "op9_cube_mix": mixing.op9_cube_mix,
    "op10_toxic_lexicon": toxicity.op10_toxic_lexicon,
}

ORACLE_SQL: dict[str, str] = {"op5_tree_merge": exact_dedup.SQL}
