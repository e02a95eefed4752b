"""Corpus-scale analysis, design and review of coding sequences on Spark."""
