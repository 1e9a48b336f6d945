"""The same alignment over Structured Streaming."""
