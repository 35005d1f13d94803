"""Operators for preparing training data: rules, de-duplication, tokenising, packing.

Nothing else in ``credence`` imports this subpackage.
"""
