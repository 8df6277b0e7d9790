"""Composed queries and the driver's query catalog."""
