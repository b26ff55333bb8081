"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lexbolt.llm import bpe, divergence, exact_dedup, licenses, mixing, packing, periods, quality, simhash, sketches, tokens, toxicity, warc

QUERIES = {
    "op3_license_scan": licenses.op3_license_scan,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op8_toxicity": toxicity.op8_toxicity,
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op4_warc_archive": warc.op4_warc_archive,
    "op2_token_ids": tokens.op2_token_ids,
    "op6_document_fingerprints": sketches.op6_document_fingerprints,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_byte_bpe": bpe.op11_byte_bpe,
    "op12_periodic_runs": periods.op12_periodic_runs,
    "op13_source_divergence": divergence.op13_source_divergence,
}

SQL = {
    "op3_license_scan": licenses.OP3_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op12_periodic_runs": periods.OP12_SQL,
    "op13_source_divergence": divergence.OP13_SQL,
}
