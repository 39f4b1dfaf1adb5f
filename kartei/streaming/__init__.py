"""Structured Streaming versions of judging, replay, drop flags, progress and the history sink."""
