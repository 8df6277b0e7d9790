"""Readers that give raw lines."""
