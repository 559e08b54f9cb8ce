"""Operators of a training-data pipeline: token files, joins, deduplication, extraction, classifiers.

Nothing else in the library imports this subpackage. ``queries`` registers one query per operator.
"""
