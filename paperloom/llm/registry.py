"""Queries and SQL of the corpus operators."""

from paperloom.llm import ann, bpe, compaction, conversations, exact_dedup, langid, licenses, minhash, mixing, pii, sharding, suffix_dedup, urls

MODULES = (minhash, suffix_dedup, langid, sharding, urls, exact_dedup, ann, bpe, mixing, pii, conversations, licenses, compaction)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
