"""Findings over large collections of text, and the relational questions asked of them, in Spark."""
