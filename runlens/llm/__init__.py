"""Operators that prepare text corpora for language-model training.

Every operator is a function from DataFrames to a DataFrame; ``queries.py``
holds the registered queries and their oracle SQL.
"""
