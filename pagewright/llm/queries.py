"""Queries and SQL of the operators in this subpackage."""

from __future__ import annotations

from .audit import OP13_SQL, op13_filter_audit
from .chat import OP8_SQL, op8_chat_format
from .digests import op5_document_fingerprints
from .jaccard import op12_jaccard_join
from .mixing import OP3_SQL, op3_mix_sources
from .packing import op10_pack_sequences
from .periodic import op11_periodic_runs
from .quality import op6_quality_scores
from .secrets import OP7_SQL, op7_secret_scan
from .simhash import op2_simhash_near_dedup
from .token_counts import op9_token_counts
from .vafile import OP4_SQL, op4_exact_top_k
from .warc import OP1_SQL, op1_warc_captures


def queries() -> dict:
    return {
        "op1_warc_captures": op1_warc_captures,
        "op2_simhash_near_dedup": op2_simhash_near_dedup,
        "op3_mix_sources": op3_mix_sources,
        "op4_exact_top_k": op4_exact_top_k,
        "op5_document_fingerprints": op5_document_fingerprints,
        "op6_quality_scores": op6_quality_scores,
        "op7_secret_scan": op7_secret_scan,
        "op8_chat_format": op8_chat_format,
        "op9_token_counts": op9_token_counts,
        "op10_pack_sequences": op10_pack_sequences,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_jaccard_join": op12_jaccard_join,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_captures": OP1_SQL,
        "op3_mix_sources": OP3_SQL,
        "op4_exact_top_k": OP4_SQL,
        "op7_secret_scan": OP7_SQL,
        "op8_chat_format": OP8_SQL,
        "op13_filter_audit": OP13_SQL,
    }
