"""Live subscriptions on Structured Streaming."""
