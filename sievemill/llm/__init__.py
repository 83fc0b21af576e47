"""Training-data operators: token files, classifiers, search, packing, near-duplicates, mixing, sharding.

Nothing outside this subpackage imports it.
"""
