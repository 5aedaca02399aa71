"""Operators for large-scale training data; nothing else in the library imports this subpackage."""

from . import byte_pairs, conversations, decontaminate, exact_dedup, lexical_search, lm_scoring, ngram_join, quality, repeats, sentencepieces, token_counts, url_lists, warc

MODULES = (ngram_join, exact_dedup, decontaminate, lm_scoring, quality, repeats, sentencepieces, token_counts, url_lists, warc, byte_pairs, conversations, lexical_search)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
