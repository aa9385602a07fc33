"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import importance, lm, media, mixing, ngramjoin, pieces, quality, recompress, repeats, search, secrets, toxicity, warc

QUERIES = {
    "op1_media_columns": media.op1_media_columns,
    "op2_secret_scans": secrets.op2_secret_scans,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_lm_scoring": lm.op5_lm_scoring,
    "op6_ngram_jaccard_join": ngramjoin.op6_ngram_jaccard_join,
    "op7_warc": warc.op7_warc,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_suffix_array_dedup": repeats.op9_suffix_array_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_importance_resampling": importance.op11_importance_resampling,
    "op12_ranked_search": search.op12_ranked_search,
    "op13_substring_dedup": recompress.op13_substring_dedup,
}

ORACLES = {
    "op4_quality_rules": quality.ORACLE_SQL,
    "op8_mix_sources": mixing.ORACLE_SQL,
    "op11_importance_resampling": importance.ORACLE_SQL,
    "op12_ranked_search": search.ORACLE_SQL,
    "op13_substring_dedup": recompress.ORACLE_SQL,
}
