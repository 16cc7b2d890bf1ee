"""Structured Streaming: ticks to bars, and indicators on bars as they close."""
