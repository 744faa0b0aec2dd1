"""Operators for training-data pipelines over text, vector and page tables.

Every operator takes and returns DataFrames.  Nothing outside this folder imports it.
"""
