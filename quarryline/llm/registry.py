"""Queries of the corpus operators."""

from __future__ import annotations

from . import oracles
from .chat import op5_chat_formatting
from .decontamination import op1_decontamination
from .divergence import op12_source_divergence_audit
from .fingerprints import op3_fingerprints
from .language_id import op6_language_id
from .line_dedup import op11_line_dedup
from .near_dedup import op2_minhash_near_dedup
from .quality import op7_quality_classifier
from .ranked_search import op13_ranked_search
from .sampled_pieces import op10_sentencepiece
from .secrets import op9_secret_scans
from .sharding import op8_sharding, sharding_law
from .substring_dedup import op4_substring_dedup

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_fingerprints": op3_fingerprints,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_language_id": op6_language_id,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_sharding": op8_sharding,
    "op9_secret_scans": op9_secret_scans,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_line_dedup": op11_line_dedup,
    "op12_source_divergence_audit": op12_source_divergence_audit,
    "op13_ranked_search": op13_ranked_search,
    "sharding_law": sharding_law,
}
#: Of those that SQL can express; the others are held against brute force, round trips or held-out rows in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op2_minhash_near_dedup": oracles.NEAR_DEDUP,
    "op4_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op5_chat_formatting": oracles.CHAT,
    "op9_secret_scans": oracles.SECRETS,
    "op11_line_dedup": oracles.LINE_DEDUP,
    "op12_source_divergence_audit": oracles.DIVERGENCE,
    "op13_ranked_search": oracles.RANKED_SEARCH,
    "sharding_law": oracles.SHARDING_LAW,
}
