"""The queries of this package and their SQL equivalents."""

from appcensus.llm import (
    exact_dedup,
    lexical_search,
    maxscore,
    merkle_manifest,
    mixing,
    ngram_join,
    quality_model,
    quality_rules,
    secret_scan,
    token_planes,
    tool_calls,
    toxicity,
    tree_bpe,
)

MODULES = (
    exact_dedup,
    lexical_search,
    maxscore,
    merkle_manifest,
    mixing,
    ngram_join,
    quality_model,
    quality_rules,
    secret_scan,
    token_planes,
    tool_calls,
    toxicity,
    tree_bpe,
)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
