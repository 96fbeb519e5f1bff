"""Operators of a training-data pipeline: toxicity, tokens, page text,
archives, quality, duplicates, mixtures and fingerprints.

Nothing else in the library imports this subpackage.  ``queries`` registers
one query per operator; each operator module has its own general interface.
"""
