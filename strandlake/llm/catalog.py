"""The queries of this package, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import (
    decontaminate, html_text, jaccard_join, licenses, masked_lm, merkle, mixing, quality_model, quality_rules, sharding, toxicity,
    url_filter, vector_codes,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        quality_rules.op1_quality_rules, toxicity.op2_toxicity, quality_model.op3_quality, jaccard_join.op4_jaccard_join,
        decontaminate.op5_decontaminate, sharding.op6_sharding, mixing.op7_mixing, html_text.op8_html,
        masked_lm.op9_masked_lm, licenses.op10_licenses, merkle.op11_merkle,
        url_filter.op12_url_filter, vector_codes.op13_vector_codes,
    )
}

ORACLES: dict[str, str] = {
    "op4_jaccard_join": jaccard_join.OP4_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op6_sharding": sharding.op6_sql(),
    "op7_mixing": mixing.OP7_SQL,
    "op11_merkle": merkle.op11_sql(),
    "op12_url_filter": url_filter.op12_sql(),
    "op13_vector_codes": vector_codes.op13_sql(),
}
