"""Composed analyses and the registered queries."""
