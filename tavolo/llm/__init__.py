"""Training-data operators: tokens, near-duplicates, personal data, search,
line and passage dedup, quality, packing and url rules, as Spark jobs.

Nothing outside this subpackage imports it.
"""
