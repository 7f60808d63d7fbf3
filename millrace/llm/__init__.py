"""Operators for preparing training text at scale.

Nothing outside this package imports it; it can be deleted and the rest of the
library still works.  ``queries`` holds the thin registered queries.
"""
