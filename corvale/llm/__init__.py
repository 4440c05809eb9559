"""Operators for preparing training data at scale.

Nothing else in the package imports this subpackage; the queries that apply
its operators to whole tables are in :mod:`corvale.llm.registry`.
"""
