"""Operators for preparing training corpora: one module for each, with its queries and SQL."""
