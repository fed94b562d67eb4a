"""Incremental landing of histories and folding of late rows into stored edges, as Structured Streaming queries."""
