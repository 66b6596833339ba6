"""Operators of a large-scale text and vector pipeline.

Nothing else in the library imports this subpackage, so it can be removed as a whole.
"""
