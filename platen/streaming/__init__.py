"""Streaming of the scan engine."""
