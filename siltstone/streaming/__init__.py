"""Incremental builds and standing searches."""
