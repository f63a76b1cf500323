"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from . import bpe_reuse, decontaminate, exact_dedup, filter_audit, html_extract, language_id, line_dedup, minhash_dedup, simhash_dedup, substring_dedup, suffix_dedup, token_counts, vector_codes
from .common import table


def queries() -> dict:
    return {
        "op1_html_extract": lambda s, d: html_extract.extract_pages(table(s, d, "pages")),
        "op2_decontaminate": lambda s, d: decontaminate.contaminated(table(s, d, "documents"), table(s, d, "benchmark")),
        "op3_simhash_near_dedup": lambda s, d: simhash_dedup.near_duplicates(table(s, d, "documents")),
        "op4_token_counts": lambda s, d: token_counts.count_tokens(table(s, d, "documents")),
        "op5_exact_dedup": lambda s, d: exact_dedup.exact_duplicates(table(s, d, "documents")),
        "op6_substring_dedup": lambda s, d: substring_dedup.substring_duplicates(table(s, d, "documents")),
        "op7_language_id": lambda s, d: language_id.identify(table(s, d, "documents")),
        "op8_suffix_array_dedup": lambda s, d: suffix_dedup.suffix_duplicates(table(s, d, "documents")),
        "op9_bpe_round_trip": lambda s, d: bpe_reuse.round_trip(table(s, d, "documents")),
        "op10_line_dedup": lambda s, d: line_dedup.line_duplicates(table(s, d, "documents")),
        "op11_vector_codes": lambda s, d: vector_codes.vector_codes(table(s, d, "embeddings")),
        "op12_minhash_near_dedup": lambda s, d: minhash_dedup.near_duplicates(table(s, d, "documents")),
        "op13_filter_interactions": lambda s, d: filter_audit.filter_interactions(table(s, d, "documents"), table(s, d, "labels")),
    }


def oracle_sql() -> dict:
    """What plain SQL can say; the other operators are tested against brute force."""
    return {
        "op11_vector_codes": vector_codes.oracle_sql(),
        "op12_minhash_near_dedup": minhash_dedup.ORACLE_SQL,
        "op13_filter_interactions": filter_audit.ORACLE_SQL,
        "op5_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    }
