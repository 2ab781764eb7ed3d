"""Training-data operators: token counts, duplicate search, scans, formatting and language ID.

Nothing outside this subpackage imports it.  `queries.py` registers one query per operator.
"""
