"""Queries and SQL of this subpackage, by name."""

from gleaner.llm import bpe, conversations, decontaminate, fingerprints, hmm, language, licenses, near_dedup, negatives, passages, quality, segment_bpe, token_counts

MODULES = (near_dedup, bpe, licenses, token_counts, language, quality, fingerprints, hmm, decontaminate, passages, segment_bpe, conversations, negatives)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: q for m in MODULES for name, q in m.SQL.items()}
