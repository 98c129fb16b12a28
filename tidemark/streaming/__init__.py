"""Structured Streaming pipelines and the sinks they write."""
