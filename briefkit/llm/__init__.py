"""Operators for training-data pipelines over a table of documents.

Nothing else in the library imports this subpackage; it borrows only the
general session helpers.  ``queries.py`` registers one query per operator.
"""
