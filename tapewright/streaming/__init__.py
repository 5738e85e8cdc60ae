"""The append-only feeds as Structured Streaming."""
