"""Training-data operators: quality, toxicity, language, near and exact duplicates, tokens, mixing.

Each module holds one operator (a general function over DataFrames); ``queries.py``
applies each to its whole table and derives the digest columns. Nothing outside
this package imports it.
"""
