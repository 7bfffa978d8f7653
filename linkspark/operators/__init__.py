"""Relational, graph, statistical and learning operators."""
