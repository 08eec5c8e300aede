"""Structured Streaming forms of the log and edit operators."""
