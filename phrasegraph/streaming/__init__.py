"""Structured Streaming jobs for incoming labels."""
