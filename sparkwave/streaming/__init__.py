"""The measurements on Structured Streaming."""
