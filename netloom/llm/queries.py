"""Queries of the corpus operators by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import op1_langid, op10_html, op11_hard_negatives, op12_licenses, op13_lexical, op2_bpe, op3_fingerprints, op4_urls, op5_jaccard_join, op6_decontaminate, op7_shards, op8_toxicity, op9_secrets

QUERIES = {
    "op1_language_id": op1_langid.query,
    "op2_byte_bpe": op2_bpe.query,
    "op3_fingerprints": op3_fingerprints.query,
    "op4_url_filter": op4_urls.query,
    "op5_jaccard_join": op5_jaccard_join.query,
    "op6_decontaminate": op6_decontaminate.query,
    "op7_shards": op7_shards.query,
    "op8_toxicity": op8_toxicity.query,
    "op9_secrets": op9_secrets.query,
    "op10_html_text": op10_html.query,
    "op11_hard_negatives": op11_hard_negatives.query,
    "op12_license_scan": op12_licenses.query,
    "op13_lexical_search": op13_lexical.query,
}

ORACLE_SQL: dict[str, str] = {"op4_url_filter": op4_urls.SQL, "op11_hard_negatives": op11_hard_negatives.SQL, "op12_license_scan": op12_licenses.SQL, "op13_lexical_search": op13_lexical.SQL}
