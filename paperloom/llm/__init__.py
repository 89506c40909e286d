"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
