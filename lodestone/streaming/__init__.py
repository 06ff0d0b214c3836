"""Structured Streaming builds."""
