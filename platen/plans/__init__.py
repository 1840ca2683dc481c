"""Plans of the scan engine."""
