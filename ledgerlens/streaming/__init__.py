"""Structured Streaming forms of the detectors."""
