"""Whole jobs, each put together from the operators."""
