"""Operators for preparing large training-data collections.

Nothing outside of this subpackage imports it.
"""
