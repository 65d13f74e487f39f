"""Resumable runs on Structured Streaming."""
