"""Tick-data analytics as composable DataFrame functions for batch and Structured Streaming."""
