"""Complaint triage and model governance as PySpark DataFrame operators.

Every operator is a plain function that takes DataFrames and returns a
DataFrame, so it can be used directly or through ``df.transform``.
"""
