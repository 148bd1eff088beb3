"""Training-data operators: one module each, plus the queries and SQL that use them.

Nothing outside this subpackage imports it.
"""
