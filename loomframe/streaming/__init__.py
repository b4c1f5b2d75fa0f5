"""Streaming of loomframe."""
