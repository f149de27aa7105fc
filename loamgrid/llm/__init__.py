"""Training-data operators: quality, toxicity, deduplication, packing, tokenizing, media, licences, sharding.

Nothing outside this subpackage imports it.
"""
