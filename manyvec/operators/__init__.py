"""Relational and vector operators over token tables."""
