"""Operators on ordinary node and edge DataFrames."""
