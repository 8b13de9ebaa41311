"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann_forest, chroma, gru_lm, mix_budget, ngram_join, pack_ga, periodic_runs, quality_crf, quality_votes, secret_scan, source_divergence, token_histogram, url_reputation

QUERIES = {
    "op1_quality_crf": quality_crf.query,
    "op2_ngram_join": ngram_join.query,
    "op3_url_reputation": url_reputation.query,
    "op4_ann_forest": ann_forest.query,
    "op5_mix_budget": mix_budget.query,
    "op6_pack_ga": pack_ga.query,
    "op7_gru_lm": gru_lm.query,
    "op8_token_histogram": token_histogram.query,
    "op9_secret_scan": secret_scan.query,
    "op10_chroma": chroma.query,
    "op11_periodic_runs": periodic_runs.query,
    "op12_quality_votes": quality_votes.query,
    "op13_source_divergence": source_divergence.query,
}
SQL = {"op2_ngram_join": ngram_join.SQL, "op3_url_reputation": url_reputation.SQL, "op12_quality_votes": quality_votes.SQL, "op13_source_divergence": source_divergence.SQL}
