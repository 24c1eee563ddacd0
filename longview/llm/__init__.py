"""Operators for preparing language-model training data on Spark.

Nothing outside this package imports it; its queries are listed in ``registry``.
"""
