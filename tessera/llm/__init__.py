"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; ``queries`` and ``oracle_sql`` in
:mod:`tessera.llm.queries` are what the entry module registers.
"""
