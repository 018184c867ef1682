"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import bpe, decontaminate, divergence, filteraudit, katz, langid, mainhtml, metricjoin, neardup, substrings, suffixlevels, toxicity, warc

QUERIES = {
    "op1_katz_backoff": katz.query,
    "op6_substring_dedup": substrings.query,
    "op4_embedding_range_join": metricjoin.query,
    "op5_ngram_jaccard_join": neardup.query,
    "op9_decontaminate": decontaminate.query,
    "op2_warc_revisits": warc.query,
    "op7_main_html": mainhtml.query,
    "op3_toxicity_ftrl": toxicity.query,
    "op8_language_id": langid.query,
    "op10_bpe_codec": bpe.query,
    "op11_suffix_levels": suffixlevels.query,
    "op12_filter_audit": filteraudit.query,
    "op13_source_divergence": divergence.query,
}

SQL: dict[str, str] = {
    "op2_warc_revisits": warc.SQL,
    "op4_embedding_range_join": metricjoin.SQL,
    "op11_suffix_levels": suffixlevels.SQL,
    "op12_filter_audit": filteraudit.SQL,
    "op13_source_divergence": divergence.SQL,
}
