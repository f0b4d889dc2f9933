"""Training-data operators: language ID, search, mixing, quality, URL rules, tokens, dedup, PII, packing.

Nothing else in the library imports this subpackage; ``queries`` registers its keys.
"""
