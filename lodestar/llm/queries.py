"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from lodestar.llm import decontaminate, kneser_ney, packing, quality_cnn, quality_rules, secrets, sharding, simhash, substring_dedup, token_files
from lodestar.llm.oracles import ORACLES

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_simhash": simhash.op2_simhash,
    "op3_sharding": sharding.op3_sharding,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_packing": packing.op5_packing,
    "op6_kneser_ney": kneser_ney.op6_kneser_ney,
    "op7_quality_cnn": quality_cnn.op7_quality_cnn,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_secrets": secrets.op9_secrets,
    "op10_token_files": token_files.op10_token_files,
}


def queries() -> dict:
    import corpus_pipeline

    return {**QUERIES, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
