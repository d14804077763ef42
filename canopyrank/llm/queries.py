"""The registered queries of this subpackage, by name."""

from __future__ import annotations

from canopyrank.llm import attribution, chat, concurrency, decontaminate, filter_audit, langid, packing, quality, secrets_scan, simhash, toxicity, urls, vector_dedup

QUERIES = {
    "op1_token_counts": attribution.op1,
    "op2_decontaminate": decontaminate.op2,
    "op3_secret_scan": secrets_scan.op3,
    "op4_chat": chat.op4,
    "op5_toxicity": toxicity.op5,
    "op6_simhash": simhash.op6,
    "op7_url_filter": urls.op7,
    "op8_quality": quality.op8,
    "op9_packing": packing.op9,
    "op10_language": langid.op10,
    "op11_filter_audit": filter_audit.op11,
    "op12_vector_dedup": vector_dedup.op12,
    "op13_concurrency": concurrency.op13,
}
