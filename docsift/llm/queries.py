"""Queries of the corpus operators, by the name under which they are registered."""

from . import bpe_codec, filter_audit, html_extract, langid, merkle, mixing, multiset_hash, nndescent, packing, quality, simhash, token_counts, url_filter

QUERIES = {
    "op7_embedding_near_dedup": nndescent.op7_embedding_near_dedup,
    "op6_language_id": langid.op6_language_id,
    "op5_quality_classifier": quality.op5_quality_classifier,
    "op8_html_extraction": html_extract.op8_html_extraction,
    "op10_url_filter": url_filter.op10_url_filter,
    "op9_mixing": mixing.op9_mixing,
    "op2_multiset_fingerprints": multiset_hash.op2_multiset_fingerprints,
    "op3_packing": packing.op3_packing,
    "op4_token_counts": token_counts.op4_token_counts,
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_bpe_codec": bpe_codec.op12_bpe_codec,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op11_filter_audit": filter_audit.ORACLE_SQL,
    "op13_merkle_manifest": merkle.ORACLE_SQL,
}
