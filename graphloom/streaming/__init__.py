"""Structured Streaming forms of incremental refresh and execution history."""
