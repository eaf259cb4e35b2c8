"""Registered queries and their SQL, by module."""
