"""Relational operators of discovery: expansion, scoring, ranking, graphs, topics, sessions, metrics."""
