"""Structured Streaming forms of stateless classification and the frontier."""
