"""Operators of the scan engine."""
