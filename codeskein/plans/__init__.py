"""Whole queries and pipelines put together from the operators."""
