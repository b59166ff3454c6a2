"""Structured Streaming: validating a change feed with the integrity rules."""
