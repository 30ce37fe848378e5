"""Operators over change logs and runs."""
