"""Operators for preparing large text corpora for language-model training.

Ten operators (see the module names) and the queries that apply them to the
driver tables.  Nothing outside this subpackage imports it.
"""
