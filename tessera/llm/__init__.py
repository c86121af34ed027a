"""Operators and jobs of a large-scale training-data pipeline.

Nothing outside this subpackage imports it; it only uses the library's general
helpers (session, staging).
"""
