"""Structured Streaming: continuous scoring of arriving cases."""
