"""Operators for large training-data corpora (text, tokens, archives, conversations).

Nothing else in the package imports this subpackage; the driver entry adds its
queries only when it can be imported.
"""
