"""The queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from tessera.llm import ann, bpe, conversation_repair, filter_audit, jaccard, langid, line_dedup, media, mixing, pii, quality, url_filter, warc

QUERIES = {
    f.__name__: f
    for f in (
        pii.op1_pii_pseudonyms,
        line_dedup.op2_line_dedup,
        mixing.op3_source_mix,
        ann.op4_adaptive_scan,
        quality.op5_quality_classifier,
        media.op6_media_columns,
        bpe.op7_bpe,
        langid.op8_language_id,
        jaccard.op9_ngram_jaccard,
        warc.op10_warc_bundles,
        filter_audit.op11_filter_audit,
        url_filter.op12_url_filters,
        conversation_repair.op13_conversation_repair,
    )
}

#: Operators 1 and 3 to 8 are tested against brute force, round trips or held-out accuracy instead.
ORACLES = {"op2_line_dedup": line_dedup.SQL, "op9_ngram_jaccard": jaccard.SQL, "op10_warc_bundles": warc.SQL, "op11_filter_audit": filter_audit.SQL}
