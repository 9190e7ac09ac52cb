"""Operators for large training corpora.

Nothing outside this folder imports it.  ``queries.py`` registers the thin
queries, ``oracles.py`` their SQL where SQL can express them.
"""
