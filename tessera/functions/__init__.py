"""Exact numeric helpers."""
