"""Whole jobs: logs in, tables out."""
