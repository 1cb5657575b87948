"""Training-data operators: near-duplicate search, tokenisation, packing, filtering.

Nothing else in the package imports this subpackage.  Operators take and return
DataFrames; ``queries`` holds the thin registered queries.
"""
