"""The subpackage's queries and the SQL for those that SQL can express."""

from __future__ import annotations

from recordframe.llm import jaccard_join, lm_scoring, mixing, pii, quality_rules, secret_scans, sentencepiece_codec, sharding, topk_search, url_filters

QUERIES = {
    "op1_secret_scans": secret_scans.op1_secret_scans,
    "op2_sharding": sharding.op2_sharding,
    "op3_sentencepiece_codec": sentencepiece_codec.op3_sentencepiece_codec,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_mixing": mixing.op6_mixing,
    "op7_url_filters": url_filters.op7_url_filters,
    "op8_pii": pii.op8_pii,
    "op9_topk_search": topk_search.op9_topk_search,
    "op10_lm_scoring": lm_scoring.op10_lm_scoring,
}
ORACLES: dict[str, str] = {
    "op1_secret_scans": secret_scans.ORACLE,
    "op4_jaccard_join": jaccard_join.ORACLE,
    "op9_topk_search": topk_search.ORACLE,
}
