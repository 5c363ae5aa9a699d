"""Registered queries, each with the SQL it is held against."""
