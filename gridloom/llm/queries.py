"""The queries of this subpackage and, where SQL can express them, their twins for DuckDB."""

from __future__ import annotations

from .decontaminate import op1_decontaminate
from .embedding_dedup import op11_embedding_dedup
from .exact_dedup import op7_exact_dedup
from .filter_audit import ORACLE_SQL as FILTER_AUDIT_SQL
from .filter_audit import op13_filter_audit
from .html_text import op8_html_text
from .licences import op2_licence_scan
from .mixing import op3_mixing
from .near_join import op4_ngram_jaccard
from .quality import op9_quality
from .repeats import op10_suffix_dedup
from .secrets import op5_secret_scan
from .toxicity import op6_toxicity
from .whitening import op12_whitening

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_licence_scan": op2_licence_scan,
    "op3_mixing": op3_mixing,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_secret_scan": op5_secret_scan,
    "op6_toxicity": op6_toxicity,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_html_text": op8_html_text,
    "op9_quality": op9_quality,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_embedding_dedup": op11_embedding_dedup,
    "op12_whitening": op12_whitening,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL = {
    "op13_filter_audit": FILTER_AUDIT_SQL,
    "op7_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
}
