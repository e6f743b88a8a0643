"""Training-data operators: mixing, archives, near-duplicate joins, sharding, packing,
language labels, language-model scores, media columns, fingerprints and licence scans.

Nothing outside this subpackage imports it.
"""
