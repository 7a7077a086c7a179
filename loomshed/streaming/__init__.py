"""Structured Streaming: tables replayed as streams, sinks that give their rows back, state of one's own."""
