"""Operators that prepare text for language-model training.

Nothing outside this subpackage imports it.  ``registry`` holds the queries and
their SQL; each operator module holds one reusable operator.
"""
