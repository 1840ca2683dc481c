"""Functions of the scan engine."""
