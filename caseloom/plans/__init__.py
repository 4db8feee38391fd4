"""Whole passes composed from the operators."""
