"""Queries over tables, built from operators."""
