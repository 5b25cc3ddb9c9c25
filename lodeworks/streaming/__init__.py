"""Structured Streaming: files indexed as they arrive, and churn over event-time windows."""
