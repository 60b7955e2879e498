"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from rookery.llm import bpe, exact_dedup, gam, jaccard_join, knn, mixing, packing, pii, rules, secrets, spelling, warc, whitening

MODULES = (secrets, pii, mixing, jaccard_join, knn, warc, exact_dedup, bpe, packing, gam, whitening, spelling, rules)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
