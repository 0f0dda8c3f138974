"""Composed top-level jobs."""
