"""Queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from halyard.llm import align, ann, chat, exact_dedup, jaccard_join, langid, licenses, line_dedup, manifest, packing, spm, url_filters, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_ngram_jaccard_join": jaccard_join.op2_ngram_jaccard_join,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_warc_revisits": warc.op5_warc_revisits,
    "op6_sentencepiece": spm.op6_sentencepiece,
    "op7_packing": packing.op7_packing,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_nearest_neighbours": ann.op9_nearest_neighbours,
    "op10_language_id": langid.op10_language_id,
    "op11_url_filters": url_filters.op11_url_filters,
    "op12_cross_tokenizer_alignment": align.op12_cross_tokenizer_alignment,
    "op13_merkle_manifest": manifest.op13_merkle_manifest,
}

ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op3_chat_formatting": chat.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op5_warc_revisits": warc.ORACLE,
    "op8_license_scan": licenses.oracle(),
    "op9_nearest_neighbours": ann.ORACLE,
    "op11_url_filters": url_filters.oracle(),
    "op13_merkle_manifest": manifest.ORACLE,
}
