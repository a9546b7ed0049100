"""Change application: buffered, batch and Structured Streaming."""
