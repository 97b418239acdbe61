"""Whole plans: the named queries and their SQL."""
