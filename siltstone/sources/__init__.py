"""Corpora and stored indexes."""
