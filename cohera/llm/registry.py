"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohera.llm import decontam, langid, lmscore, packing, quality, sharding, simhash, tokens, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [tokens.op1_token_counts, quality.op2_quality_rules, warc.op3_warc, langid.op4_language_id, decontam.op5_decontamination, sharding.op6_sharding, toxicity.op7_toxicity, lmscore.op8_lm_scoring, packing.op9_best_fit_packing, simhash.op10_simhash_near_dedup]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality.OP2_SQL, "op3_warc": warc.OP3_SQL, "op5_decontamination": decontam.OP5_SQL}
