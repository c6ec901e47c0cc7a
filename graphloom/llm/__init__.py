"""Operators that prepare text, page and vector tables for model training.

Each module holds one operator with a general interface; the thin ``opN_*``
queries that bind them to the standard tables live in :mod:`.queries`.
Nothing outside this subpackage imports it.
"""
