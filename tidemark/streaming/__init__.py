"""Structured Streaming: ingestion into a store, and throughput."""
