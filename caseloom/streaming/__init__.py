"""Structured Streaming: catalogue arrivals, record status and token runs."""
