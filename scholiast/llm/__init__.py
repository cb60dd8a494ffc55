"""Training-data operators: near-duplicate search, filtering, scoring, formatting, mixing and extraction.

Nothing outside this package imports it.
"""
