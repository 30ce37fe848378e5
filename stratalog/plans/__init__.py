"""Whole-log plans: command replay and metrics."""
