"""Queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from . import _session, chat_format, decontaminate, jaccard_join, language_id, packing, quality, simhash, substring_dedup, token_count, url_filter



def _prepared(query):
    def run(spark, sf_dir):
        _session.prepare(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_substring_dedup": _prepared(substring_dedup.query),
    "op2_chat_formatting": _prepared(chat_format.query),
    "op3_language_id": _prepared(language_id.query),
    "op4_ngram_jaccard_join": _prepared(jaccard_join.query),
    "op5_decontamination": _prepared(decontaminate.query),
    "op6_url_filters": _prepared(url_filter.query),
    "op7_quality_classifier": _prepared(quality.query),
    "op8_simhash": _prepared(simhash.query),
    "op9_packing": _prepared(packing.query),
    "op10_token_counts": _prepared(token_count.query),
}

ORACLES = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op2_chat_formatting": chat_format.ORACLE,
    "op4_ngram_jaccard_join": jaccard_join.ORACLE,
    "op6_url_filters": url_filter.ORACLE,
}
