"""Incremental (Structured Streaming) runs."""
