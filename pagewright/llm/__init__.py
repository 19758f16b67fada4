"""Operators of a training-data pipeline: tokens, mixtures, duplicates, scans, quality and languages.

Nothing else in the library imports this subpackage.
"""
