"""Operators for preparing training text: filters, dedup, tokenizers, decontamination.

Nothing else in the library imports this subpackage.
"""
