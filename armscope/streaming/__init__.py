"""Monitoring of live experiments with Structured Streaming."""
