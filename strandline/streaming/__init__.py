"""Structured Streaming facades over the batch operators."""
