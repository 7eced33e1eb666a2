"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from skillweave.llm import (
    embedding_dedup,
    html_text,
    jaccard_join,
    language_id,
    line_dedup,
    lm_scoring,
    pieces,
    prefix_trie,
    source_mixing,
    suffix_dedup,
    topk_search,
    toxicity,
    whitening,
)

_MODULES = (suffix_dedup, source_mixing, line_dedup, toxicity, html_text, topk_search, lm_scoring, jaccard_join, embedding_dedup, pieces, language_id, prefix_trie, whitening)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
