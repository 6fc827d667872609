"""The subpackage's queries and, where SQL can express them, their DuckDB equivalents."""

from quillspark.llm import centroids, filter_audit, fingerprint, langid, licenses, line_dedup, mixing, ngram_join, pieces, suffix_dedup, toxicity, vector_dedup, word_bpe

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.query,
    "op2_embedding_near_dedup": vector_dedup.query,
    "op3_license_scan": licenses.query,
    "op4_line_dedup": line_dedup.query,
    "op4_line_dedup_all_lines": line_dedup.query_all_lines,
    "op5_toxicity": toxicity.query,
    "op6_source_mixing": mixing.query,
    "op7_sentencepiece": pieces.query,
    "op8_suffix_array_dedup": suffix_dedup.query,
    "op9_language_id": langid.query,
    "op10_document_fingerprints": fingerprint.query,
    "op11_filter_audit": filter_audit.query,
    "op12_centroid_clustering": centroids.query,
    "op13_word_bpe": word_bpe.query,
}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": ngram_join.ORACLE,
    "op2_embedding_near_dedup": vector_dedup.ORACLE,
    "op3_license_scan": licenses.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op4_line_dedup_all_lines": line_dedup.ORACLE_ALL_LINES,
    "op6_source_mixing": mixing.ORACLE,
    "op8_suffix_array_dedup": suffix_dedup.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_centroid_clustering": centroids.ORACLE,
}
