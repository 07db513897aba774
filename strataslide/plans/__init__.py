"""Registered queries with their SQL twins."""
