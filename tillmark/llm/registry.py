"""All registered queries of the document operators, with their SQL equivalents."""

from __future__ import annotations

from . import (
    chat_format, exact_dedup, hard_negatives, jaccard_join, line_dedup, mixing, packing, phrases, quality, secret_scan,
    token_counts, topk_search, url_filter,
)

MODULES = [
    quality, topk_search, token_counts, exact_dedup, packing, mixing, line_dedup, url_filter, secret_scan, jaccard_join,
    chat_format, hard_negatives, phrases,
]

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in getattr(module, "ORACLE", {}).items()}
