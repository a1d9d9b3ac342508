"""Structured Streaming forms of decomposable aggregates."""
