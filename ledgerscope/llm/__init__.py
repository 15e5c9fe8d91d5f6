"""Training-data operators: search, quality, dedup, tokenisation and archives.

Each module holds one operator; ``queries`` registers the thin ``opN_<name>``
queries.  Nothing outside this subpackage imports it.
"""
