"""Operators for preparing training text, each with a query over the test tables."""
