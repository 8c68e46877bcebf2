"""Whole questions put together from the operators."""
