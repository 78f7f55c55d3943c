"""Structured Streaming forms of the burst and rule operators."""
