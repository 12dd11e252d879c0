"""The queries of this folder and the SQL of those that SQL can express."""

from . import embedding_dedup, html_extraction, lm_scoring, mixing, ngram_join, packing, quality_classifier, quality_rules, token_counts, url_filter

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_quality_classifier": quality_classifier.op2_quality_classifier,
    "op3_html_extraction": html_extraction.op3_html_extraction,
    "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_packing": packing.op6_packing,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_mixing": mixing.op8_mixing,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_lm_scoring": lm_scoring.op10_lm_scoring,
}
ORACLES = {
    "op5_url_filter": url_filter.ORACLE_SQL,
    "op7_quality_rules": quality_rules.ORACLE_SQL,
    "op8_mixing": mixing.ORACLE_SQL,
}
