"""Streams of fold results."""
