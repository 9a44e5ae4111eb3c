"""Registered queries: each composes operators over the given tables."""
