"""Queries of the training-data operators, and SQL that gives the same rows."""

from __future__ import annotations

from corpus_pipeline import run as pipeline

from .chat_format import OP6_SQL, op6_chat_format
from .collocations import OP11_SQL, op11_collocations
from .embedding_dedup import OP8_SQL, op8_embedding_dedup
from .language_id import op2_language_id
from .license_scan import OP4_SQL, op4_license_scan
from .near_dedup import OP3_SQL, op3_near_dedup
from .packing import op9_packing
from .piece_codec import op7_piece_codec
from .quality_rules import OP13_SQL, op13_quality_rules
from .substring_dedup import OP1_SQL, op1_substring_dedup
from .token_counts import op5_token_counts
from .vector_codes import OP12_SQL, op12_vector_codes
from .vector_search import OP10_SQL, op10_vector_search

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_language_id": op2_language_id,
    "op3_near_dedup": op3_near_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_token_counts": op5_token_counts,
    "op6_chat_format": op6_chat_format,
    "op7_piece_codec": op7_piece_codec,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_packing": op9_packing,
    "op10_vector_search": op10_vector_search,
    "op11_collocations": op11_collocations,
    "op12_vector_codes": op12_vector_codes,
    "op13_quality_rules": op13_quality_rules,
    "pipeline": pipeline,
}

ORACLE = {
    "op1_substring_dedup": OP1_SQL,
    "op3_near_dedup": OP3_SQL,
    "op4_license_scan": OP4_SQL,
    "op6_chat_format": OP6_SQL,
    "op8_embedding_dedup": OP8_SQL,
    "op10_vector_search": OP10_SQL,
    "op11_collocations": OP11_SQL,
    "op12_vector_codes": OP12_SQL,
    "op13_quality_rules": OP13_SQL,
}
