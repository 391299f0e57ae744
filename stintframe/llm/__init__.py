"""Operators for preparing training data: counting, cleaning, deduplicating, packing and storing text.

Nothing outside this subpackage imports it.  Each module holds one operator with a general interface;
``queries`` holds the thin registered queries.
"""
