"""Queries of the training-data operators and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from . import importance, jaccard, lexical, licences, mixing, packing, pii, quality, simhash, sstable, substrings, topk, warc

QUERIES = {
    "op1_license_scan": licences.query,
    "op2_warc_conversion": warc.query,
    "op3_ngram_jaccard": jaccard.query,
    "op4_sstable_shards": sstable.query,
    "op5_feistel_pseudonyms": pii.query,
    "op6_suffix_dedup": substrings.query,
    "op7_pivot_topk": topk.query,
    "op8_residual_packing": packing.query,
    "op9_quality_rules": quality.query,
    "op10_raked_mixing": mixing.query,
    "op11_importance_resampling": importance.query,
    "op12_lexical_search": lexical.query,
    "op13_simhash_vantage_points": simhash.query,
}
ORACLES: dict[str, str] = {
    "op1_license_scan": licences.ORACLE_SQL,
    "op7_pivot_topk": topk.ORACLE_SQL,
    "op10_raked_mixing": mixing.ORACLE_SQL,
    "op12_lexical_search": lexical.ORACLE_SQL,
}
