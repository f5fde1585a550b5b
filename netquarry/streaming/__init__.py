"""Following live logs with Structured Streaming."""
