"""Operators for preparing large text collections for model training.

Nothing outside this subpackage imports it.
"""
