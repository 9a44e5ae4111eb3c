"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from tidewave.llm import (
    chat_format, conversation_trie, decontaminate, html_extract, langid, lexical, line_dedup, mixing, quality, similar, suffix_dedup, topk, url_filter,
)

QUERIES: dict = {}
ORACLES: dict = {}

_MODULES = (
    mixing, similar, chat_format, topk, url_filter, langid, decontaminate, line_dedup, quality, suffix_dedup,
    lexical, conversation_trie, html_extract,
)

for _module in _MODULES:
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
