"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every module keeps its own general interface; the
thin ``opN_`` queries in :mod:`lectern.llm.queries` apply them to the test tables.
"""
