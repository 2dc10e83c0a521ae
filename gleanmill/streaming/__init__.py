"""The feed poll as a Structured Streaming job."""
