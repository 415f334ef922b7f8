"""Frame logs as streams."""
