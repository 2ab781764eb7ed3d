"""Structured Streaming: screening of outbound documents as they arrive."""
