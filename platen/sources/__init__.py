"""Sources of the scan engine."""
