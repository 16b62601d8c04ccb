"""Corpus operators for training data: filters, deduplication, tokenising, scoring.

Nothing outside this folder imports it. `registry` holds the queries and their SQL.
"""
