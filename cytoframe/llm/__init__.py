"""Operators for preparing large-scale language-model training data.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own interface; ``queries`` holds the thin ``opN_*`` queries.
"""
