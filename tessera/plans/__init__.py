"""Indicators and reports composed from the operators."""
