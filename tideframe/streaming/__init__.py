"""Structured Streaming: tape capture, bars, consensus and running indicators."""
