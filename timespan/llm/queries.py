"""The queries of the training-data operators, and their DuckDB twins."""

from timespan.llm import decontamination, merkle, ngram_jaccard, quality_rules, secret_scans, sharding, warc
from timespan.llm.alignment import op12_cross_tokenizer_alignment
from timespan.llm.license_scans import op8_license_scans
from timespan.llm.lm_scoring import op10_lm_scoring
from timespan.llm.packing import op9_best_fit_packing
from timespan.llm.pii import op3_pii
from timespan.llm.quality_classifier import op2_quality_classifier

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_pii": op3_pii,
    "op4_ngram_jaccard": ngram_jaccard.op4_ngram_jaccard,
    "op5_secret_scans": secret_scans.op5_secret_scans,
    "op6_warc": warc.op6_warc,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_license_scans": op8_license_scans,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_cross_tokenizer_alignment": op12_cross_tokenizer_alignment,
    "op13_sharding": sharding.op13_sharding,
}
ORACLE: dict[str, str] = {
    "op1_quality_rules": quality_rules.ORACLE_SQL,
    "op4_ngram_jaccard": ngram_jaccard.ORACLE_SQL,
    "op5_secret_scans": secret_scans.ORACLE_SQL,
    "op6_warc": warc.ORACLE_SQL,
    "op7_decontamination": decontamination.ORACLE_SQL,
    "op11_merkle_manifest": merkle.ORACLE_SQL,
    "op13_sharding": sharding.ORACLE_SQL,
}
