"""Streaming use of the monitor."""
