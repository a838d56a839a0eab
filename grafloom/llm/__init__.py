"""Operators that prepare training text at scale.

Nothing outside this package imports it; ``queries`` and ``oracle_sql`` of
:mod:`grafloom.llm.queries` are what the driver registers.
"""
