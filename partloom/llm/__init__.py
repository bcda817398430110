"""Training-data operators: scans, filters, dedup, scoring, mixing, packing.

Nothing outside this subpackage imports it; ``queries.py`` registers its
queries and their SQL.
"""
