"""Queries: the operators bound to stored tables."""
