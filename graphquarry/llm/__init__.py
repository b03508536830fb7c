"""Operators for preparing large training corpora on Spark.

Nothing else in the package imports this subpackage.
"""
