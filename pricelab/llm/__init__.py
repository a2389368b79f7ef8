"""Operators of a training-data pipeline (de-duplication, tokens, classifiers, extraction, mixing, search).

Nothing else in the package imports this subpackage. ``queries`` holds the
registered queries ``opN_<name>`` and their SQL.
"""
