"""Structured Streaming face of model reuse."""
