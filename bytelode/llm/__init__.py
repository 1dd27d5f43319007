"""Training-data operators: dedup, formatting, decontamination, sharding, packing, scoring.

Nothing outside this subpackage imports it.
"""
