"""Regex search over large text corpora with a trigram index, as Spark jobs."""
