"""Structured Streaming twins of the arrival-order operators."""
