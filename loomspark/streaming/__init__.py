"""Structured Streaming over event tails: windows, rolling means, reducers, notices told once."""
