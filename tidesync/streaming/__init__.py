"""Structured Streaming: continuous keyed sync."""
