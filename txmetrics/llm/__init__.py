"""Operators for preparing training data: one module for each, their registered queries in ``queries``.

Nothing else in the library imports this package.
"""
