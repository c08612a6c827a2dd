"""Live forms of the event operators in Structured Streaming."""
