"""Readers and writers of record, graph, offer, label, feature and pair files."""
