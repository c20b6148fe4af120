"""Column functions: no shuffle, no action."""
