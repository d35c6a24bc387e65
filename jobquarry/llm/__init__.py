"""Operators for preparing training corpora.

Each module holds one operator with a general interface over DataFrames; ``queries`` holds the thin
``opN_<name>`` queries that bind them to the standard tables. Nothing outside this subpackage imports it.
"""
