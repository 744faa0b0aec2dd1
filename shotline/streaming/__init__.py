"""Structured Streaming jobs of the engine."""
